"""Exact similarity join on word shingles with a token-group matrix.

A document is the set of its distinct shingles. Equal sets become one class first. For a class Q of
n shingles to reach Jaccard t with another, at least ceil(t n) of its shingles must be shared, so
one of its n - ceil(t n) + 1 rarest shingles is. The matrix row of such a shingle names a group of
possibly similar classes; rows that name the same classes are looked at once. Every class shows a
parity sketch of its set there (less than a bit per shingle): the bits in which two sketches differ
are a lower bound of the shingles in which the sets do. The pairs that this bound leaves partition
the classes into groups (connected components), so each class is in one group, and only classes with
a possible partner travel with their sets. Inside a cell (a group, or two blocks of a large one)
classes are kept in subgroups of linked ones, each with the union of its tokens; a query's overlap with the union
bounds its overlap with every member, and only qualifying groups are opened and compared exactly.
A query that has met one link of a group needs no other there, so a dense group costs about one
comparison per class and yields a spanning forest, never all pairs.

Rareness: shingles that several documents of a task share are summed up over all tasks and the
``RANKED`` most frequent ones go last in the order. This table only sets the order (any order gives
the same links), so its fixed size leaves nothing out.

Defined results: null and empty texts have an empty set and link with nothing; texts shorter than
a shingle count as one shingle; equal texts link; repeated ids and rows link by their texts, and
the smallest id of a component names it (null ids are ignored there unless all are null). Shingles
and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlane.llm.blocks import WordHashes, rolling, sheltered, small, stored, text_blocks, values, whole_runs
from pactlane.llm.components import components

RANKED = 1 << 18  # most frequent shingles that go last in the order of rareness
CHUNK = 1_500_000  # shingles of a task whose counts are summed up at a time
SHARED = 3  # documents of a chunk that must share a shingle for it to be summed up
SKETCHED_CLASSES = 1024  # a larger row of the matrix is sieved as pairs of blocks of this size
BLOCK_CLASSES, BLOCK_TOKENS = 256, 128_000  # a larger group is opened as pairs of blocks of this size


def shingle_sets(texts: list, width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = text.lower().split() if text else ()
        counts[k] = len(own)
        words += own
    h = hashes.of(words)
    starts, owner = whole_runs(counts, width)
    grams = rolling(h, width)[starts]
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    first = np.cumsum(counts) - counts
    out = []
    for k, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(grams[edge[k] : edge[k + 1]]))
        else:
            out.append(rolling(h[first[k] : first[k] + n], int(n)) if n else np.empty(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def sketch_bits(n: int, num: int, den: int) -> int:
    """Bits of a sketch: unrelated sets differ in about half of them, more than linked ones may."""
    return 1 << max(6, (6 * n * (den - num) // (den + num)).bit_length())


def sketch(tokens: np.ndarray, num: int, den: int) -> bytes | None:
    """Parity of the shingles that fall on each bit."""
    if not len(tokens):
        return None
    bits = sketch_bits(len(tokens), num, den)
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(x: int, bits: int, to: int) -> int:
    """The sketch over fewer bits."""
    while bits > to:
        bits >>= 1
        x = (x & ((1 << bits) - 1)) ^ (x >> bits)
    return x


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = k = root[root[k]]
    return k


def candidates(members: list[tuple[int, int, bytes]], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest over (class, size, sketch) of the pairs that sizes and sketches allow to link."""
    members = sorted(set(members), key=lambda m: (m[1], m[0]))
    bits = [8 * len(s) for _, _, s in members]
    marks = [int.from_bytes(s, "little") for _, _, s in members]
    root, out = list(range(len(members))), []
    for k, (name, n, _) in enumerate(members):
        for o in range(k - 1, -1, -1):
            size = members[o][1]
            if size * den < num * n:
                break
            if _find(root, o) == _find(root, k):
                continue
            b = min(bits[k], bits[o])
            apart = (folded(marks[k], bits[k], b) ^ folded(marks[o], bits[o], b)).bit_count()
            if apart * (den + num) <= (den - num) * (n + size):
                root[_find(root, k)] = _find(root, o)
                out.append((members[o][0], name))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def _classes(width: int, num: int, den: int):
    """Per document its set's size and class; per chunk the shingles that several documents share."""

    def summary(sets: list) -> pa.RecordBatch:
        tokens, df = np.unique(np.concatenate(sets), return_counts=True)
        often = df >= SHARED
        row = [None, None, None, None, None, tokens[often].tobytes(), df[often].astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.binary()), ("df", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk, size, seen = WordHashes(), [], 0, set()
        for batch, texts in text_blocks(batches):
            sets = shingle_sets(texts, width, hashes)
            ids = [class_of(s) for s in sets]
            for c, s in zip(ids, sets, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    chunk.append(s)
                    size += len(s)
            blank = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values(batch, "doc_id"), pa.int64()), pa.array(values(batch, "text_hash"), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array([sketch(s, num, den) for s in sets], pa.binary()), blank, blank],
                schema=schema,
            )
            if size > CHUNK:
                yield summary(chunk)
                chunk, size, seen = [], 0, set()
        if chunk:
            yield summary(chunk)

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tokens, df in zip(values(batch, "tokens"), values(batch, "df"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(np.frombuffer(df, np.int32).astype(np.int64))], names=["token", "df"])


def _rare(width: int, num: int, den: int, ranked):
    """The rarest shingles of every class, one of which any linked class shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        often, rank = ranked.value
        for _, texts in text_blocks(batches):
            tokens, classes, sizes = [], [], []
            for s in shingle_sets(texts, width, hashes):
                n, c = len(s), class_of(s)
                # a different set of at most n / t shingles must exist
                if c is None or c in seen or n * den < num * (n + 1) and least_overlap(n, num, den) >= n:
                    continue
                seen.add(c)
                tokens.append(s)
                classes.append(c)
                sizes.append(n)
            if len(seen) > 500_000:
                seen.clear()
            if not tokens:
                continue
            flat, size = np.concatenate(tokens), np.array(sizes)
            order = np.zeros(len(flat), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                order = np.where(often[at] == flat, rank[at], 0)
            owner = np.repeat(np.arange(len(size)), size)
            flat = flat[np.argsort(owner * (len(often) + 1) + order, kind="stable")]
            prefix = size - np.array([least_overlap(n, num, den) for n in sizes]) + 1
            take = (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)) < np.repeat(prefix, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[take].view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), prefix)), pa.array(np.repeat(size, prefix))], names=["token", "class", "n"]
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in text_blocks(batches):
            sets = shingle_sets(texts, width, hashes)
            rows = [(c, s.tobytes()) for c, s in zip(values(batch, "class"), sets, strict=True) if class_of(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["class", "tokens"])

    return run


def linked(classes: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the classes of one cell."""
    order = sorted(range(len(classes)), key=lambda k: (len(sets[k]), classes[k]))
    classes, sets = [classes[k] for k in order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(df > 1) - 1  # tokens of a single class cannot be shared
    shared, edge = df[code] > 1, np.cumsum(size) - size
    rows = [column[code[a : a + n][shared[a : a + n]]] for a, n in zip(edge, size, strict=True)]
    width = int((df > 1).sum())
    root = list(range(len(classes)))
    edges: list[tuple[int, int]] = []
    unions: list[np.ndarray] = []  # tokens of a group, as a row over the shared tokens
    groups: list[list[int]] = []
    own = np.zeros(width, bool)
    for q, row in enumerate(rows):
        need = least_overlap(int(size[q]), num, den)
        home = -1
        if len(row) >= need:
            bound = np.array([int(u[row].sum()) for u in unions], np.int64)
            own[row] = True
            for g in np.argsort(-bound, kind="stable"):
                if bound[g] < need:
                    break
                if _find(root, groups[g][0]) == _find(root, q):
                    continue
                for at, k in enumerate(groups[g]):
                    if size[k] * den < num * size[q]:
                        continue
                    both = int(own[rows[k]].sum())
                    if both * den >= num * (size[k] + size[q] - both):
                        edges.append((classes[k], classes[q]))
                        root[_find(root, q)] = _find(root, k)
                        groups[g].insert(0, groups[g].pop(at))
                        home = g if home < 0 else home
                        break
            own[row] = False
            if home < 0:
                groups.append([q])
                unions.append(np.zeros(width, bool))
            else:
                groups[home].append(q)
            unions[home][row] = True
    return edges


def _cells(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of one cell after another from sorted batches; one cell is held at a time."""
    cell, rows = None, []
    for batch in batches:
        for k, row in zip(zip(*(values(batch, n) for n in key), strict=True), zip(*(values(batch, n) for n in columns), strict=True), strict=True):
            if k != cell:
                yield rows
                cell, rows = k, []
            rows.append(row)
    yield rows


def _each_cell(key: tuple[str, ...], columns: tuple[str, ...], edges):
    """Edges (a, b) of every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for rows in _cells(batches, key, columns):
            if len(rows) > 1:
                out += edges(rows)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _sieve(num: int, den: int):
    return _each_cell(("token", "i", "j"), ("class", "n", "sketch"), lambda rows: candidates(rows, num, den))


def _open(num: int, den: int):
    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        members = dict(rows)
        return linked(list(members), [np.frombuffer(t, np.uint64) for t in members.values()], num, den)

    return _each_cell(("group", "i", "j"), ("class", "tokens"), edges)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"])


def _in_blocks(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """(key, i, j, class) for every pair of blocks (i <= j) that a row's block takes part in."""
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class", key), "blocks"))
    with_each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return rows.select(key, "class", F.explode(with_each).alias("c")).select(key, "class", "c.i", "c.j")


def similar(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash (xxhash64 of the text),
    n_shingles, class, component (a class) and component_id (smallest doc_id of the component).
    Documents link from a Jaccard similarity of num / den."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seen = stored(docs.mapInArrow(_classes(width, num, den), "doc_id long, text_hash long, n long, class long, sketch binary, tokens binary, df binary"), "classes")
    known = seen.where("n IS NOT NULL").select("doc_id", "text_hash", "n", "class")

    top = seen.where("tokens IS NOT NULL").select("tokens", "df").mapInArrow(_spread, "token long, df long")
    top = top.groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(RANKED).toArrow()
    often = top.column("token").to_numpy().view(np.uint64)
    by = np.argsort(often)
    ranked = spark.sparkContext.broadcast((often[by], (len(often) - np.arange(len(often)))[by]))

    rare = stored(docs.select("text").mapInArrow(_rare(width, num, den, ranked), "token long, class long, n long"), "rare")
    # rows of the matrix that name the same classes are opened once: told by count, smallest and sums of hashes
    parts = [lambda c: F.xxhash64(c).bitwiseAND(0x7FFFFFFF), lambda c: F.shiftrightunsigned(F.xxhash64(c), 33)]
    rows = rare.groupBy("token").agg(F.count("*").alias("m"), F.min("class").alias("low"), *[F.sum(p("class")).alias(f"s{k}") for k, p in enumerate(parts)])
    rows = rows.where((F.col("s0") != F.col("m") * parts[0]("low")) | (F.col("s1") != F.col("m") * parts[1]("low")))
    rows = stored(rows.groupBy("m", "low", "s0", "s1").agg(F.min("token").alias("token")).select("token", "m"), "rows")
    cells = _in_blocks(rare.join(small(rows, 16), "token").select("token", "m", "class").distinct(), "token", F.ceil(F.col("m") / SKETCHED_CLASSES))
    shown = seen.where("class IS NOT NULL").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    cells = cells.join(shown, "class").select("token", "i", "j", "class", "n", "sketch")
    maybe = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_sieve(num, den), "a long, b long")

    # what may link, directly or by others, is one group of the partition
    groups = components(maybe).select(F.col("node").alias("class"), F.col("root").alias("group"))
    bearers = known.join(groups, "class").groupBy("class").agg(F.first("group").alias("group"), F.first("n").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("d"))
    bearers = stored(bearers.select("class", "group", "n", F.col("d.doc_id").alias("b_id"), F.col("d.text_hash").alias("b_hash")), "bearers")
    sizes = bearers.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("size"))
    cells = _in_blocks(bearers.join(sizes, "group"), "group", F.col("size"))
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))
    sets = docs.join(small(bearers.select("class", "b_id", "b_hash"), 40), same)
    sets = sets.select("class", "text").mapInArrow(_sets(width), "class long, tokens binary")
    opened = cells.join(sets, "class").select("group", "i", "j", "class", "tokens")
    edges = opened.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_open(num, den), "a long, b long")

    label = components(edges)
    firsts = known.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(label.withColumnRenamed("node", "class"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    names = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = firsts.join(names, "root").select(F.col("class").alias("c"), F.col("root").alias("component"), "component_id")
    out = known.join(of_class, F.col("class") == F.col("c"), "left")
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "class", "component",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


@sheltered("doc_id", "text")
def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the smallest (doc_id, text hash), nulls first. Rows
    with an empty set link with nothing and all stay."""
    found = stored(similar(docs, width, num, den).where("class IS NOT NULL").select("doc_id", "text_hash", "component"), "similar")
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"), F.count("*").alias("n")).where("n > 1")
    rows = found.join(best, "component").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") == F.col("best")).alias("stays"))
    rows = stored(rows.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "dropped")
    gone = rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(small(gone, 32), same, "left_anti")
    again = rows.where("stays").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    if again.limit(1).count():  # exact repeats of a row that stays: one of them comes back
        kept = kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept
