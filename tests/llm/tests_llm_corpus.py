"""A small corpus with every kind of row that operators must bear."""

import random

IDS_AND_TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """A small corpus with nulls, empty, blank and long texts, copies, shared passages and repeated rows of words."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéßñ中") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [say(70) for _ in range(3)]
    texts = [None, "", "   \n\t ", "one", "...", "a b c", " lead and trail ", "x" * 300, "ab " * 200, "\n".join(["same line here"] * 30)]
    for _ in range(n):
        parts = [say(rnd.randint(0, 60)), rnd.choice([*shared, ""]), say(rnd.randint(0, 60))]
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[12], texts[12], texts[20] + " tail", say(3000), texts[15].replace(vocabulary[0], vocabulary[1])]
    base = say(200).split()
    for k in range(12):  # near copies
        other = list(base)
        for _ in range(k):
            other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
        texts.append(" ".join(other))
    rnd.shuffle(texts)
    return [(7 * i + 3, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
