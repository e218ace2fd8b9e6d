"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes hits a mask, so a passage that many documents
share falls into the same chunks in each of them, wherever it stands. Chunks are looked up first:
the ids of a chunk that the worker's memo (two generations, bounded) holds are reused as they are, and only the
words of unknown chunks and of joins are encoded. A cut may fall inside a word: the stretch around a join is
re-encoded outward, from the join to the white space nearest on either side - over as many chunks as it takes - and
ends where its ids agree with both sides: the tokenizer starts afresh at white space, so ids beyond it are
those the chunks already have.

The tokenizer drops white space, and neither its normaliser (NFC, lower case) nor its special
tokens reach across ASCII white space. ``tests/llm`` compares with the library on any Unicode text.

Results in every case: null and empty texts have no ids and decode to the empty text; ties and
repeated rows are encoded alike; rows without an id are left out; an empty table gives an empty result; a long
text is encoded whole, in a slab of its own; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tsforge.llm.tables import id_and_text, tidy
from tsforge.llm.textcodes import BYTE_CODES, Ranges, mix, slabs

TOKENIZER_FILE = "word_bpe_49k.json"
#: Bytes that the rolling hash looks back over; a cut on average every CHUNK bytes.
LOOK_BACK, CHUNK = 16, 256
#: Sizes of the memos of one worker: words and chunks of a generation; the last generation but one goes.
WORDS_KEPT, CHUNKS_KEPT = 200_000, 20_000
_MARK, _MARK_BYTE, _GLUE, _TOGETHER = "\x01", b"\x01", b" \x01 ", 2000
#: Words that the short way is tried on; the letters it takes.
_PROBES = ("a", "Hello", "WORLD.", "straße,", "Élan", "ÀÖØöøÿ.", "zzzzqqqqxxxx", "internationalisation,")
_PLAIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level tokenizers write for each byte: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()
_GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids of white-space separated words, each distinct one encoded once while the memo holds it.

    The memo has two generations: when the younger is full it becomes the elder and the former elder
    goes, so words that keep coming stay and memory is bounded.
    """

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.strings = [self.tok.id_to_token(i) or "" for i in range(self.vocab_size)]
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        #: A sign that is one id when it stands alone; it keeps words apart that are encoded in one call.
        alone = self.ids(_MARK)
        self.mark = int(alone[0]) if len(alone) == 1 else None
        self.kept = kept
        self.memo: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}
        self.merge = self.tok.model.tokenize
        # the short way is taken only if it agrees with the library on these words
        self.short = False
        self.ends = {x: self.ids(x).tobytes() for x in ("", ".", ",")}
        if all(len(v) <= 4 for v in self.ends.values()):
            self.short = all(self.plain(w.encode()) == self.ids(w).tobytes() for w in _PROBES)

    def plain(self, word: bytes) -> bytes | None:
        """ids of a word of Latin letters, perhaps with a full stop or comma behind: such letters are one piece
        for the tokenizer, composed already, so its merges run on the lower-case bytes directly."""
        found = _PLAIN.fullmatch(word.decode())
        if found is None:
            return None
        letters = found[1].lower()
        raw = letters.encode()
        got = self.memo.get(raw)
        if got is None or not self.short:
            ids = [t.id for t in self.merge(letters if letters.isascii() else raw.decode("latin-1").translate(_BYTE_SIGNS))]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if self.short:
                self.memo[raw] = got
        return got + self.ends[found[2]]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[bytes]) -> None:
        """See that the memo holds ``words``; those it lacks are encoded together."""
        if len(self.memo) > self.kept:
            self.elder, self.memo = self.memo, {}
        memo, elder = self.memo, self.elder
        new = []
        for w in words.difference(memo):
            got = elder.get(w)
            if got is None and self.short:
                got = self.plain(w)
            if got is None:
                new.append(w)
            else:
                memo[w] = got
        for k in range(0, len(new), _TOGETHER):
            part = new[k:k + _TOGETHER]
            joined = _GLUE.join(part)
            odd = self.mark is None or joined.count(_MARK_BYTE) != len(part) - 1 or any(x in joined for x in self.specials)
            got = None if odd or len(joined) > 64 * _TOGETHER else self.ids(joined.decode())
            if got is None:
                for w in part:
                    memo[w] = self.ids(w.decode()).tobytes()
                continue
            ends = np.append(np.flatnonzero(got == self.mark), len(got)).tolist()
            raw, begin = got.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                memo[w] = raw[4 * begin:4 * end]
                begin = end + 1

    def words(self, words: list[bytes]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            self.learn(set(words))
            return b"".join([self.memo[w] for w in words])

    def slab(self, slab) -> Iterator[bytes]:
        """ids of each text of a slab, word by word."""
        texts = [slab.text(i).split() for i in range(len(slab))]
        self.learn(set().union(*texts))
        for words in texts:
            yield self.words(words)

    def decode(self, ids: np.ndarray) -> str:
        """The library's decode(ids, skip_special_tokens=False): this tokenizer file names no decoder,
        so the token strings are joined by spaces."""
        s = self.strings
        return " ".join([s[i] for i in ids.tolist()])


class ChunkEncoder:
    """ids of whole texts from chunks that recur."""

    def __init__(self, words: WordEncoder, chunk: int = CHUNK, kept: int = CHUNKS_KEPT):
        self.words, self.kept = words, kept
        self.every = np.uint64(chunk)
        self.memo: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.elder: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.reused = self.encoded = 0  # bytes of chunks whose ids were known, and of those encoded

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where a chunk ends, by content; never inside a UTF-8 character."""
        if len(data) <= LOOK_BACK:
            return np.zeros(0, np.int64)
        rolling = mix(Ranges(BYTE_CODES[data]).windows(LOOK_BACK))
        at = np.flatnonzero(rolling % self.every == 0) + LOOK_BACK
        for _ in range(3):
            inside = at < len(data)
            inside[inside] = (data[at[inside]] & 0xC0) == 0x80
            at = at + inside
        return np.unique(at[at < len(data)])

    @staticmethod
    def fragments(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """(what comes before the first white space, the bytes between, what comes after the last); the middle is None
        for a chunk without white space."""
        first = _GAP.search(chunk)
        if first is None:
            return chunk, None, b""
        i, j = first.start(), len(chunk) - 1
        while chunk[j] not in b" \t\n\r\x0b\x0c":
            j -= 1
        return chunk[:i], chunk[i:j + 1], chunk[j + 1:]

    def known(self, chunk: bytes) -> tuple[bytes, bytes | None, bytes] | None:
        """(head, ids of the words between, tail) of a chunk that has been encoded."""
        got = self.memo.get(chunk)
        if got is None and (got := self.elder.get(chunk)) is not None:
            self.memo[chunk] = got
        return got

    def add(self, chunk: bytes, split: tuple[bytes, bytes | None, bytes]) -> tuple[bytes, bytes | None, bytes]:
        """Encode a new chunk."""
        head, between, tail = split
        got = head, None if between is None else self.words.words(between.split()), tail
        if len(self.memo) >= self.kept:
            self.elder, self.memo = self.memo, {}
        if len(chunk) <= 8 * int(self.every):
            self.memo[chunk] = got
        return got

    def joined(self, parts: list[tuple[bytes, bytes | None, bytes]]) -> Iterator[bytes | list[bytes]]:
        """A text's chunks as ids (bytes) and the words around joins that are to be encoded anew (one-word lists)."""
        open_word = []
        for head, core, tail in parts:
            open_word.append(head)
            if core is None:
                continue
            if join := b"".join(open_word):
                yield [join]
            yield core
            open_word = [tail]
        if join := b"".join(open_word):
            yield [join]

    def slab(self, slab) -> Iterator[bytes]:
        """ids of each text of a slab, as little-endian 32-bit numbers."""
        raw = slab.data.tobytes()
        at = np.unique(np.concatenate([self.cuts(slab.data), slab.at]))
        bounds = np.searchsorted(at, slab.at).tolist()
        at = at.tolist()
        chunks = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        here, new = {}, {}
        for c in chunks:
            if c in here:
                self.reused += len(c)
            elif (got := self.known(c)) is not None:
                here[c] = got
                self.reused += len(c)
            else:
                here[c] = new[c] = self.fragments(c)
                self.encoded += len(c)
        # the words of new chunks are encoded together, then those around joins
        self.words.learn(set().union(*(between.split() for _, between, _ in new.values() if between)))
        for c, split in new.items():
            here[c] = self.add(c, split)
        texts = [list(self.joined([here[c] for c in chunks[bounds[i]:bounds[i + 1]]])) for i in range(len(slab))]
        self.words.learn({x[0] for t in texts for x in t if isinstance(x, list)})
        for t in texts:
            yield b"".join([self.words.words(x) if isinstance(x, list) else x for x in t])


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, chunk: int = CHUNK) -> ChunkEncoder:
    """One per worker process, so that its memos serve all tasks run there."""
    if (path, chunk) not in _encoders:
        _encoders[path, chunk] = ChunkEncoder(WordEncoder(path), chunk)
    return _encoders[path, chunk]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, as the tokenizers library gives them."""
    path = path or tokenizer_path()

    def run(batches):
        enc = encoder(path, chunk)
        for b in batches:
            for s in slabs(b.column("text")):
                ids = [np.frombuffer(x, "<u4") for x in enc.slab(s)]
                ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, decoded string): the text of an id list; null lists give the empty text."""
    path = path or tokenizer_path()

    def run(batches):
        words = encoder(path).words
        for b in batches:
            text = [words.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "decoded"])

    return df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids").mapInArrow(tidy(run), "doc_id long, decoded string")


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                       chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every whole text by chunk reuse and decode
    the ids again in the same pass, keeping digests only."""
    path = path or tokenizer_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(path, chunk)
        numbers = [str(i) for i in range(enc.words.vocab_size)]
        for b in batches:
            for s in slabs(b.column("text")):
                n, ids_sha, text_sha = [], [], []
                for raw in enc.slab(s):
                    ids = np.frombuffer(raw, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([numbers[i] for i in ids.tolist()]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(enc.words.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(df, id_col, text_col).mapInArrow(tidy(run), schema)
