"""An audit of how the sources of each language differ in their words, by tiles of group blocks.

A group is a (language, source).  Terms are counted by group; a language keeps the terms that MIN_DOCS of
its documents have.  A term's share in a group or language, in units of 10^-9 with one added to each count,
is compared with its share elsewhere: f = (p - q)^2 div q, in whole numbers throughout.

The vocabulary is dealt to chunks by a hash.  A first shuffle brings each chunk's counts together, packed: a
task sends one row of columns for each chunk, not one for each term and group.  What comes out is a count
vector for each group and chunk.  For the pairs, groups are dealt to blocks of about BLOCK; a vector is
replicated to every tile (two blocks of a language) that its block is part of, and a tile's tasks go through
a range of chunks each, one after the other, with two dense slices of the chunk in memory, and add up their
pairs.  Terms that neither block of a tile has need no slice: their part follows from how many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm import terms
from inkstone.llm.common import broadcast_if_small, small_batches, written

MIN_DOCS, TOP = 3, 200
#: Groups of a block, about.
BLOCK = 64
#: Chunks that a tile's task goes through, about.
RANGE = 8
#: Chunks of a language's vocabulary where the input's size is unknown.
UNSIZED = 256
#: Terms of a chunk that are dense in memory at once.
SLICE = 4096
#: Distinct (group, term) that a task counts before it hands them over.
HELD = 1 << 19
UNIT = 1_000_000_000


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) by long division, so that nothing overflows below 9 * 10^15."""
    rest = np.asarray(count, np.int64) + 1
    out = np.zeros(np.broadcast(rest, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


# ---------------------------------------------------------------- counting
def _tally(chunks: int):
    """Over (lang, source, text): for each language and chunk (lang, chunk, packed columns of source, term, count, documents)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[pa.Table] = []
        n = 0

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return t.select(["g", "term", "n_sum", "docs_sum"]).rename_columns(["g", "term", "n", "docs"]).combine_chunks()

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            langs = sorted({x for x, _ in names})
            lang_of = np.array([langs.index(x) for x, _ in names])
            g = t["g"].to_numpy()
            chunk = _chunk(t["term"].combine_chunks(), chunks)
            key = lang_of[g] * chunks + chunk
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
            t = t.take(pa.array(order))
            source = pa.array([x for _, x in names], pa.string())
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = t.slice(a, b - a)
                columns = [pa.DictionaryArray.from_arrays(own["g"].combine_chunks().cast(pa.int32()), source), own["term"].combine_chunks(), own["n"].combine_chunks(), own["docs"].combine_chunks()]
                k = int(key[order[a]])
                yield pa.RecordBatch.from_arrays([pa.array([langs[k // chunks]], pa.string()), pa.array([k % chunks]), pa.array([_packed(columns)], pa.binary())], ["lang", "chunk", "packed"])

        for batch in it:
            of = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            going: tuple[int, set] = (-1, set())  # the text that the next block goes on with, and the terms it had
            for b in terms.blocks(batch.column(2), terms.LETTERS):
                kinds = len(b.distinct)
                inner = b.of != b.end
                of_term, row = b.of[inner], b.row[inner]
                pairs = np.unique(row * kinds + of_term)
                new = np.ones(len(pairs), bool)
                if going[1]:
                    again = np.flatnonzero(pairs // kinds == going[0])
                    new[again] = [x not in going[1] for x in b.distinct.take(pa.array(pairs[again] % kinds)).to_pylist()]
                if b.of[-1] != b.end:
                    last = pairs[pairs // kinds == b.row[-1]] % kinds
                    going = (b.row[-1], (going[1] if going[0] == b.row[-1] else set()) | set(b.distinct.take(pa.array(last)).to_pylist()))
                else:
                    going = (-1, set())
                keys, at, m = np.unique(of[row] * kinds + of_term, return_inverse=True, return_counts=True)
                docs = np.bincount(np.searchsorted(keys, of[pairs // kinds] * kinds + pairs % kinds), new, minlength=len(keys)).astype(np.int64)
                if len(keys):
                    held.append(pa.table({"g": keys // kinds, "term": b.distinct.take(pa.array(keys % kinds)), "n": m, "docs": docs}))
                    n += len(keys)
                if n >= HELD:
                    held[:] = [merged()]
                    n = held[0].num_rows
                    if n >= HELD // 2:
                        yield from out(held[0])
                        held.clear()
                        n = 0
        if held:
            yield from out(merged())

    return run


def _chunk(words: pa.StringArray, chunks: int) -> np.ndarray:
    h = terms.hashes(words)
    return ((h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(20)).astype(np.int64) % chunks


def _packed(columns: list[pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


_VECTORS = "lang string, chunk long, source string, size long, total long, packed binary"


def _vectors(min_docs: int):
    """Over (lang, chunk, packed) in order: a row of the language's terms and totals, then one for each source's places and counts."""

    def finished(lang: str, chunk: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        # every (source, term) once; terms that enough documents have, in the order of their bytes
        by = t.group_by("term").aggregate([("n", "sum"), ("docs", "sum")]).combine_chunks()
        keep = by["docs_sum"].to_numpy() >= min_docs
        if not keep.any():
            return
        by = by.filter(pa.array(keep))
        term = by["term"].combine_chunks()
        yield row(lang, chunk, None, len(term), int(by["n_sum"].to_numpy().sum()), [term, by["n_sum"].combine_chunks()])
        place = pc.index_in(t["term"].combine_chunks(), value_set=term)
        t = t.select(["source", "n"]).append_column("place", place).filter(place.is_valid()).combine_chunks()
        source = t["source"].combine_chunks().dictionary_encode()
        of = source.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(source.dictionary) + 1))
        places, n = t["place"].to_numpy()[order], t["n"].to_numpy()[order]
        for k, name in enumerate(source.dictionary.to_pylist()):
            s = slice(cuts[k], cuts[k + 1])
            yield row(lang, chunk, name, len(term), int(n[s].sum()), [pa.array(places[s]), pa.array(n[s])])

    def row(lang: str, chunk: int, source: str | None, size: int, total: int, columns: list) -> pa.RecordBatch:
        arrays = [pa.array([lang], pa.string()), pa.array([chunk]), pa.array([source], pa.string()), pa.array([size]), pa.array([total]), pa.array([_packed(columns)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "chunk", "source", "size", "total", "packed"])

    def merged(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(["source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["source", "term", "n_sum", "docs_sum"]).rename_columns(["source", "term", "n", "docs"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for b in it:
            for lang, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lang, chunk) != key and held:
                    yield from finished(*key, merged(held))
                    held, n = [], 0
                key = (lang, chunk)
                t = _unpacked(data)
                held.append(pa.table([t.column(0).cast(pa.string()), *t.columns[1:]], names=["source", "term", "n", "docs"]))
                n += t.num_rows
                if n >= 2 * HELD:
                    held = [merged(held)]
                    n = held[0].num_rows
        if held:
            yield from finished(*key, merged(held))

    return run


# ---------------------------------------------------------------- terms of a group
_TERMS = "lang string, source string, item string, value long"


def _excess(top: int):
    """Over a chunk's rows, the language's first, with n (the group's or language's count of all kept terms) and v (their number): each group's best terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q, term = None, None, None
        for b in it:
            for lang, chunk, source, data, n, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = _unpacked(data)
                if source is None:
                    key, term, q = (lang, chunk), t.column(0).combine_chunks(), share(t.column(1).to_numpy(), n + v)
                    continue
                assert key == (lang, chunk)
                place = t.column(0).to_numpy()
                d, own = share(t.column(1).to_numpy(), n + v) - q[place], q[place]
                up = np.flatnonzero(d > 0)
                f = d[up] * d[up] // own[up]
                words = term.take(pa.array(place[up]))
                if len(up) > top:  # of equal values the lesser terms: Arrow compares bytes
                    best = pc.sort_indices(pa.table({"f": f, "w": words}), [("f", "descending"), ("w", "ascending")])[:top]
                    f, words = f[best.to_numpy()], words.take(best)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array([source] * len(f), pa.string()), words, pa.array(f)], ["lang", "source", "item", "value"])

    return run


# ---------------------------------------------------------------- pairs of groups
_PAIRS = "lang string, source string, item string, value long, seen long, rest long, v long"


class _Tile:
    """A tile's groups, and the sums of their pairs so far."""

    def __init__(self, lang: str, same: bool, sides: list[list[tuple]]):
        self.lang, self.same = lang, same
        self.names = [[m[0] for m in side] for side in sides]
        n = [np.array([m[1] for m in side], np.int64) for side in sides]
        self.v = next(m[2] for side in sides for m in side)  # a block can be empty, a tile is not
        self.totals = [x + self.v for x in n]
        self.sums = [np.zeros((len(n[0]), len(n[1])), np.int64) for _ in range(2)]  # first by second, second by first
        self.seen = 0

    def add(self, size: int, vectors: list[dict[int, tuple[np.ndarray, np.ndarray]]]) -> None:
        """A chunk of so many terms: by member, places and counts."""
        some = np.zeros(size, bool)
        for side in vectors:
            for place, _ in side.values():
                some[place] = True
        column = np.cumsum(some) - 1
        width = int(some.sum())
        self.seen += width
        for low in range(0, width, SLICE):
            high = min(width, low + SLICE)
            shares = []
            for side, totals in zip(vectors, self.totals, strict=True):
                dense = np.zeros((len(totals), high - low), np.int64)
                for k, (place, n) in side.items():
                    at = column[place]
                    own = (at >= low) & (at < high)
                    dense[k, at[own] - low] = n[own]
                shares.append(share(dense, totals[:, None]))
            for i, p in enumerate(shares[0]):
                d = p - shares[1]
                d *= d
                self.sums[0][i] += (d // shares[1]).sum(axis=1)
                if not self.same:
                    self.sums[1][i] += (d // p).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        none = [share(np.zeros(len(t), np.int64), t) if self.v else np.ones(len(t), np.int64) for t in self.totals]
        d = none[0][:, None] - none[1]
        out = []
        for k in range(1 if self.same else 2):
            rest = d * d // (none[1] if k == 0 else none[0][:, None])
            i, j = np.nonzero(~np.eye(*rest.shape, dtype=bool)) if self.same else np.nonzero(np.ones(rest.shape, bool))
            names = [pa.array(self.names[s], pa.string()).take(pa.array(x)) for s, x in ((0, i), (1, j))]
            out.append([*(names if k == 0 else names[::-1]), pa.array(self.sums[k][i, j]), pa.array(rest[i, j])])
        source, item, value, rest = (pa.concat_arrays(x) for x in zip(*out, strict=True))
        n = len(source)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), source, item, value, pa.array(np.full(n, self.seen)), rest, pa.array(np.full(n, self.v))], ["lang", "source", "item", "value", "seen", "rest", "v"])


def _tiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order of tile, range, chunk: first the tile's groups (chunk -1), then the vectors of each chunk."""
    key = tile = None
    members: list[list[tuple]] = [[], []]
    chunk, size, vectors = -1, 0, [{}, {}]

    def begun() -> _Tile:
        lang, a, c, _ = key
        return _Tile(lang, a == c, members if a != c else [members[0], members[0]])

    def closed() -> None:
        if chunk >= 0:
            tile.add(size, vectors if not tile.same else [vectors[0], vectors[0]])

    for b in it:
        for *now, k, block, member, source, n, v, width, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if now != key:
                if key:
                    tile = tile or begun()
                    closed()
                    yield tile.rows()
                key, tile, members, chunk = now, None, [[], []], -1
            side = 0 if block == key[1] else 1
            if k < 0:
                members[side].append((source, n, v))
                continue
            tile = tile or begun()
            if k != chunk:
                closed()
                chunk, size, vectors = k, width, [{}, {}]
            t = _unpacked(data)
            vectors[side][member] = t.column(0).to_numpy(), t.column(1).to_numpy()
    if key:
        tile = tile or begun()
        closed()
        yield tile.rows()


def chunks_for(docs: DataFrame) -> int:
    """Chunks of a language's vocabulary: the input's megabytes, as Spark estimates them, to the power 2/3, as a vocabulary grows less than its texts.

    Results don't depend on it.  Where Spark knows no size, there are UNSIZED.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return UNSIZED if size >= 1 << 60 else int(min(1 << 20, max(16, (size / (1 << 20)) ** (2 / 3))))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunks: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other of its language, and by which terms from the language.

    Part ``pair``: every other source of the language, with the sum of f over all kept terms (0 where none is
    kept).  Part ``term``: the ``top`` kept terms that the source has with a greater share than the language.
    Null texts, languages and sources are empty strings; a group without terms is one too.  Ranks go by value,
    then by the item's bytes.  Repeated rows count each.  Very long texts are read in blocks, and count as one
    document.  An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    chunks = chunks or chunks_for(docs)
    dealt = rows.mapInArrow(_tally(chunks), "lang string, chunk long, packed binary").repartition("lang", "chunk").sortWithinPartitions("lang", "chunk")
    vectors = written(dealt.mapInArrow(_vectors(min_docs), _VECTORS), "vectors")

    totals = vectors.groupBy("lang", "source").agg(F.sum("total").alias("n"), F.sum("size").alias("v"))
    whole = totals.where("source is null").select(F.col("lang").alias("l"), F.col("n").alias("whole"), F.col("v").alias("kept"))
    groups = written(rows.select("lang", "source").distinct(), "groups")
    number = groups.groupBy(F.col("lang").alias("m")).agg(F.count("*").alias("sources"))
    own = totals.where("source is not null").select(F.col("lang").alias("l2"), F.col("source").alias("s2"), "n")
    groups2 = groups.join(number, F.col("lang") == F.col("m")).join(whole, F.col("lang") == F.col("l"), "left").join(own, (F.col("lang") == F.col("l2")) & (F.col("source") == F.col("s2")), "left")
    blocks = F.ceil(F.col("sources") / block)
    groups2 = groups2.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("v"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).alias("block"))
    groups2 = written(groups2.withColumn("member", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1), "numbered")  # of a block's groups
    named = broadcast_if_small(groups2)

    # terms: a chunk's rows meet, the language's first
    shown = vectors.join(named.select("lang", "source", "n", "v"), ["lang", "source"]).select("lang", "chunk", "source", "packed", "n", "v")
    langs = vectors.where("source is null").join(broadcast_if_small(written(whole, "languages")), F.col("lang") == F.col("l")).select("lang", "chunk", "source", "packed", F.col("whole").alias("n"), F.col("kept").alias("v"))
    met = shown.unionByName(langs).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", F.col("source").asc_nulls_first())
    part_term = met.mapInArrow(_excess(top), _TERMS)

    # pairs: groups and their vectors go to every tile of their block
    tile = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ranges = max(1, chunks // RANGE)
    key = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("c")]
    described = groups2.select("lang", "source", "block", "member", "n", "v", tile).select("lang", *key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))).alias("part"), F.lit(-1).cast("long").alias("chunk"), "block", "member", "source", "n", "v", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("packed"))
    packed = vectors.join(named, ["lang", "source"]).select("lang", "chunk", "source", "size", "packed", "block", "member", "n", "v", tile)
    packed = packed.select("lang", *key, F.pmod("chunk", F.lit(ranges)).alias("part"), "chunk", "block", "member", "source", "n", "v", "size", "packed")
    dealt = described.unionByName(packed).repartition("lang", "a", "c", "part").sortWithinPartitions("lang", "a", "c", "part", "chunk", "block", "member")
    sums = dealt.mapInArrow(_tiles, _PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("rest").alias("rest"), F.first("v").alias("v"))
    part_pair = sums.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest")).alias("value"))

    both = part_pair.withColumn("part", F.lit("pair")).unionByName(part_term.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = [df.withColumn("rank", rank) for df in (both.where("part = 'pair'"), both.where("part = 'term'"))]
    out = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def divergence_sql(table: str) -> str:
    """The same in DuckDB's SQL."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda n, total: f"1 + ({UNIT}::HUGEINT * (coalesce({n}, 0) + 1)) // ({total})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{low}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM {table}),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY lang),
q AS (SELECT k.lang, term, {p("k.n", "l.n + l.v")} AS q FROM k JOIN l ON k.lang = l.lang),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n, coalesce(any_value(l.v), 0) AS v FROM g LEFT JOIN l ON g.lang = l.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, {p("c.n", "gn.n + gn.v")} AS p FROM gn JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT p.lang, source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}"""
