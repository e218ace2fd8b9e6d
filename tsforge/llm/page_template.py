"""Main text of web pages by template deduction: equivalence classes of tokens over the pages of a host.

1. Pages become streams of tokens (``page_blocks.py``): the role of every opened element, and every text block in its role.
2. A token's occurrence vector over its host's pages is stood for by a sum over the pages of a hash of the page and
   the token's count there. Tasks add up their own pages first, so a host with a third of all pages costs one
   row per token and task. Tokens with equal vectors that occur in half of a host's pages form a class, if the host
   has at least LEAST_PAGES pages of different text.
3. Pages are checked against the classes: a class is valid if its tokens come in one order, again and again, on every page,
   and no other class's round ends inside one of its rounds that it began outside of (nesting). Valid classes, nested, are the template.
4. What is not template is a slot. Text blocks in the slots are the page's candidates; blocks in surroundings (menus,
   headers, footers, sidebars, notices, adverts, forms, comments - by element, role or class word) are none. If the page marks
   its article, the candidates in it are the text, else all candidates that are not mostly links.
   Template text inside a marked article is left out only if it is on every page of a host with at least SURE_PAGES
   different ones; and a page of which the template would take more than MOST stays whole (its host's pages are near copies).

Templates are a few dozen tokens a host; they reach the pages by a broadcast where all of them take less than
BROADCAST_BYTES, else by a join salted over the pages of a host.

Results in every case: null and empty pages have an empty text; hosts with few pages have no template and rest on step 4;
pages that share an id or a content are each treated; pages without an id are left out; pages without a host form one
host; an empty table gives an empty result; pages of any length are read whole; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.page_blocks import ARTICLE, BOILER, HEADER, MAIN, read_page
from tsforge.llm.tables import bounded_batches, staged, tidy
from tsforge.llm.textcodes import mix

LEAST_PAGES, SURE_PAGES, LEAST_CLASS, MOST = 4, 8, 2, 0.8
BROADCAST_BYTES, SALTS = 16 << 20, 64
_HOLD = 400_000


def host(url):
    """The lower-case host of a url column, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def pages_with_hosts(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host(F.col(url_col).cast("string")).alias("host")) \
        .where(F.col("page_id").isNotNull())


def _digest(unit) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(unit, "<i8").tobytes(), digest_size=8).digest(), "little") >> 1


def token_streams(pages: DataFrame) -> DataFrame:
    """(page_id, host, tokens binary, content): each page's tokens in order, and a digest of its text blocks."""

    def run(batches):
        for b in batches:
            out, content = [], []
            for page in b.column("html").to_pylist():
                blocks, tokens = read_page(page)
                out.append(np.array(tokens, "<i8").tobytes())
                content.append(_digest([x.token for x in blocks]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(out, pa.binary()), pa.array(content, pa.int64())],
                                             names=["page_id", "host", "tokens", "content"])

    return pages.select("page_id", "host", "html").mapInArrow(tidy(run), "page_id long, host string, tokens binary, content long")


def occurrence_vectors(streams: DataFrame) -> DataFrame:
    """(host, token, pages, total, high, low): how many pages hold a token, how often, and its vector's sum in two
    halves. Token 0 stands for the page itself."""

    def run(batches):
        hosts, parts, held = {}, [], 0

        def rows():
            h, token, pages, total, high, low = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((token, h))
            h, token = h[order], token[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (token[1:] != token[:-1])))
            return (h[first], token[first], *(np.add.reduceat(x[order], first) for x in (pages, total, high, low)))

        def batch(columns):
            names = np.array(list(hosts), object)
            return pa.RecordBatch.from_arrays([pa.array(names[columns[0]], pa.string()), *(pa.array(x, pa.int64()) for x in columns[1:])],
                                              names=["host", "token", "pages", "total", "high", "low"])

        for b in batches:
            for page, name, raw in zip(b.column("page_id").to_pylist(), b.column("host").to_pylist(), b.column("tokens"), strict=True):
                token, n = np.unique(np.append(np.frombuffer(raw.as_buffer(), "<i8"), 0), return_counts=True)
                salt = mix(np.array([page], np.int64).astype(np.uint64))
                vector = mix(salt ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                parts.append((np.full(len(token), hosts.setdefault(name, len(hosts))), token, np.ones(len(token), np.int64), n,
                              (vector >> np.uint64(32)).astype(np.int64), (vector & np.uint64(0xFFFFFFFF)).astype(np.int64)))
                held += len(token)
                if held >= _HOLD:
                    parts = [rows()]
                    held = len(parts[0][0])
                    if held > _HOLD // 2:
                        yield batch(parts[0])
                        hosts, parts, held = {}, [], 0
        if parts:
            yield batch(rows())

    return streams.mapInArrow(tidy(run), "host string, token long, pages long, total long, high long, low long") \
        .groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "total", "high", "low")))


def classes(streams: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, contents, host_pages, classes array of (pages, tokens)): tokens with equal occurrence vectors, in half of the host's pages
    or more - so a host has at most twice as many as its pages have tokens on average."""
    contents = streams.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= least_pages)
    vectors = staged(occurrence_vectors(streams).where(F.col("pages") >= least_pages), "vectors")
    size = vectors.where("token = 0").select("host", F.col("pages").alias("host_pages")).join(contents, "host")
    same = vectors.where("token <> 0").join(size, "host").where("2 * pages >= host_pages") \
        .groupBy("host", "contents", "host_pages", "pages", "total", "high", "low").agg(F.sort_array(F.collect_list("token")).alias("tokens")) \
        .where(F.size("tokens") >= LEAST_CLASS)
    return same.groupBy("host", "contents", "host_pages").agg(F.sort_array(F.collect_list(F.struct("pages", "tokens"))).alias("classes"))


def join_hosts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the columns of their host's row, if it has one."""
    row = hosts.agg(F.sum(F.lit(64) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in hosts.dtypes if kind in ("binary", "string")))).first()
    if (row[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(hosts), "host", "left")
    spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")


def rounds(tokens: np.ndarray, owner: dict[int, int]) -> tuple[dict[int, tuple | None], set[int]]:
    """One page against its host's classes: each present class's tokens in the order of their round (None if the rounds differ), and
    the classes whose rounds are cut into."""
    seen: dict[int, list[int]] = {}
    path = [(owner[t], t) for t in tokens.tolist() if t in owner]
    for k, t in path:
        seen.setdefault(k, []).append(t)
    order: dict[int, tuple | None] = {}
    for k, got in seen.items():
        width = len(set(got))
        unit = got[:width]
        order[k] = tuple(unit) if got == unit * (len(got) // width) and len(set(unit)) == width else None
    cut: set[int] = set()
    open_: list[list[int]] = []  # class and tokens met of each round that has begun
    for k, _ in path:
        if order[k] is None:
            continue
        if any(x[0] == k for x in open_):
            while open_[-1][0] != k:  # a round inside has not ended
                cut.add(open_.pop()[0])
            open_[-1][1] += 1
        else:
            open_.append([k, 1])
        if open_[-1][1] == len(order[k]):
            open_.pop()
    return order, cut


def templates(streams: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, contents, everywhere binary, often binary): how many different pages a host has, and the tokens of valid classes, on all or on some of the host's pages."""
    found = staged(classes(streams, least_pages).withColumn("flat", F.expr(
        "flatten(transform(classes, (c, k) -> transform(c.tokens, t -> struct(t, k))))")), "classes")
    packed = _packed(found.select("host", "flat"))

    def check(batches):
        agreed, bad = {}, set()
        for b in batches:
            known = {}
            for name, raw, c, t in zip(b.column("host").to_pylist(), b.column("tokens"), b.column("k"), b.column("t"), strict=True):
                if not t.is_valid:
                    continue
                owner = known.get(name)
                if owner is None:
                    owner = known[name] = dict(zip(np.frombuffer(t.as_buffer(), "<i8").tolist(), np.frombuffer(c.as_buffer(), "<i8").tolist(), strict=True))
                order, cut = rounds(np.frombuffer(raw.as_buffer(), "<i8"), owner)
                bad.update((name, k) for k in cut)
                for k, unit in order.items():
                    if unit is None or agreed.setdefault((name, k), unit) != unit:
                        bad.add((name, k))
        rows = [(n, k, _digest(unit), (n, k) in bad) for (n, k), unit in agreed.items()] + [(n, k, 0, True) for n, k in bad if (n, k) not in agreed]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                                             names=["host", "k", "unit", "bad"])

    valid = join_hosts(streams, packed).mapInArrow(tidy(check), "host string, k long, unit long, bad boolean") \
        .groupBy("host", "k").agg(F.min("unit").alias("least"), F.max("unit").alias("most"), F.max("bad").alias("bad")) \
        .where("NOT bad AND least = most").groupBy("host").agg(F.collect_set("k").alias("valid"))
    kept = found.join(valid, "host").selectExpr("host", "contents", "host_pages", "filter(classes, (c, k) -> array_contains(valid, k)) AS classes")
    return _binary(kept.selectExpr("host", "contents", "flatten(transform(filter(classes, c -> c.pages = host_pages), c -> c.tokens)) AS everywhere",
                                   "flatten(transform(filter(classes, c -> c.pages < host_pages), c -> c.tokens)) AS often"))


def _binary(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            packed = [pa.array([np.array(x, "<i8").tobytes() for x in b.column(c).to_pylist()], pa.binary()) for c in ("everywhere", "often")]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("contents"), *packed], names=["host", "contents", "everywhere", "often"])

    return df.mapInArrow(tidy(run), "host string, contents long, everywhere binary, often binary")


def _packed(df: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            flat = b.column("flat").to_pylist()
            columns = [pa.array([np.array([x[f] for x in row], "<i8").tobytes() for row in flat], pa.binary()) for f in ("k", "t")]
            yield pa.RecordBatch.from_arrays([b.column("host"), *columns], names=["host", "k", "t"])

    return staged(df.select("host", F.expr("transform(flat, x -> named_struct('t', x.t, 'k', cast(x.k AS long))) AS flat"))
                  .mapInArrow(tidy(run), "host string, k binary, t binary"), "packed")


def main_text(page: str, everywhere: frozenset = frozenset(), often: frozenset = frozenset(), contents: int = 0) -> list[str]:
    """The blocks of a page's article: candidates in the slots that its host's template leaves."""
    blocks = [b for b in read_page(page)[0] if not b.flags & (BOILER | HEADER)]

    def slots(part, template):
        left = [b for b in part if b.token not in template]
        return left if sum(len(b.text) for b in left) >= (1 - MOST) * sum(len(b.text) for b in part) else part

    sure = everywhere if contents >= SURE_PAGES else frozenset()
    article, marked = [b for b in blocks if b.flags & ARTICLE], [b for b in blocks if b.flags & (ARTICLE | MAIN)]
    if 2 * sum(len(b.text) for b in article) >= sum(len(b.text) for b in marked):
        marked = article
    if marked:
        return [b.text for b in slots(marked, sure)]
    return [b.text for b in slots(blocks, everywhere | often) if 2 * b.linked <= len(b.text)]


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text): the main text of every page, its blocks joined by line feeds."""
    pages = pages_with_hosts(df, id_col, html_col, url_col)
    streams = staged(token_streams(pages), "tokens")
    found = staged(templates(streams, least_pages), "templates")

    def run(batches):
        for b in batches:
            known, out = {}, []
            for name, page, n, everywhere, often in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("contents").to_pylist(),
                                                        b.column("everywhere"), b.column("often"), strict=True):
                if not everywhere.is_valid:
                    out.append("\n".join(main_text(page)))
                    continue
                if name not in known:
                    known[name] = [frozenset(np.frombuffer(x.as_buffer(), "<i8").tolist()) for x in (everywhere, often)]
                out.append("\n".join(main_text(page, *known[name], n)))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return join_hosts(pages, found).select("page_id", "url", "host", "html", "contents", "everywhere", "often") \
        .mapInArrow(tidy(run), "page_id long, url string, text string")
