import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tsforge.llm import queries, spelling
from tsforge.llm.fm_index import Index


def one_edit(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        if doc_id is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def rows_of(df):
    got = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def typos(seed, n, letters="abcdeéÿz"):
    """Texts over words that differ by a few edits, some much commoner than others."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9))) for _ in range(40)]
    texts = []
    for _ in range(n):
        said = []
        for _ in range(rnd.randrange(60)):
            w = base[min(39, int(rnd.expovariate(0.15)))]
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1:]]) or "x"
            said.append(rnd.choice([w, w, w.capitalize()]))
        texts.append(rnd.choice([" ", "-", ", "]).join(said))
    return texts


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "a"])
def test_index_finds_all_words_one_edit_away(letters):
    rnd = random.Random(len(letters))
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    index = Index(np.array([ord(c) for w in words for c in w], np.uint32), np.append(0, np.cumsum([len(w) for w in words])))
    asks = sorted({*words, *("".join(rnd.choice(letters + "q") for _ in range(rnd.randint(1, 9))) for _ in range(100))}, key=len)
    for length in range(1, 10):
        some = [w for w in asks if len(w) == length]
        if not some:
            continue
        queries_ = index.symbols(np.array([[ord(c) for c in w] for w in some], np.uint32))
        for exact in range(length + 1):
            who, word = index.one_error_behind(queries_, exact)
            want = {(w, v) for w in some for v in words if v.startswith(w[:exact]) and one_edit(w, v)}
            assert {(some[a], words[b]) for a, b in zip(who, word, strict=True)} == want
            assert len(who) == len(want)
            alike = index.ends_alike(queries_, who, word, exact)
            assert [bool(x) for x in alike] == [words[b].endswith(some[a][length - exact:]) if exact else True for a, b in zip(who, word, strict=True)]


def test_query_equals_brute_force(spark, small, tmp_path):
    texts = [t for _, t, *_ in small[0]] + typos(1, 150) + [" ".join(["abcde" * 3000] * 3), "x" * 5]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "abcde abcde abcde"), (3, "zzzzz zzzzz zzzzz")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'x' AS key").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(queries.op11_fm_spelling(spark, str(tmp_path)))
    assert got == brute(rows)
    assert any(v[0] for v in got.values()) and max(v[3] for v in got.values()) > 5


def test_many_ranges_and_a_common_beginning(spark, monkeypatch):
    """Ranges of a few words, where a third of all words share their first half: all ranges that edits reach are asked."""
    monkeypatch.setattr(spelling, "RANGE", 12)
    texts = typos(2, 120) + [" ".join(f"prefix{a}{b}" for a in "abcdefghij" for b in "abcdefghij") for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), typo=spelling.crc_typo))
    assert got == brute(rows)
    assert got["prefixab"][3] >= 18


def test_asked_ranges_hold_all_edits():
    rnd = random.Random(4)
    words = sorted({"ab" + "".join(rnd.choice("abcé") for _ in range(rnd.randint(3, 6))) for _ in range(400)})
    cuts = words[5::7]
    for w in words[::9]:
        asked = spelling.asked_ranges(w, len(w) // 2, cuts)
        import bisect
        need = {bisect.bisect_right(cuts, v) for v in words if v.startswith(w[:len(w) // 2]) and one_edit(w, v)}
        assert need <= set(asked) and len(asked) <= len(cuts) + 1


def test_chains_plain_words_and_empty_table(spark, nothing):
    assert spelling.variants(nothing).count() == 0
    n = {"abcdea": 3, "abcdeab": 6, "abcdeabc": 12, "abcdeabcd": 24, "other": 5}
    text = " ".join(w for w, k in n.items() for _ in range(k))
    got = rows_of(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert got["abcdea"] == ("abcdeab", "abcdeabcd", 3, 1, 6)
    assert got["abcdeabc"] == ("abcdeabcd", "abcdeabcd", 12, 2, 24)
    assert got["other"] == (None, "other", 5, 0, None)
    with pytest.raises(ValueError, match="commoner"):
        spelling.variants(nothing, factor=1)
