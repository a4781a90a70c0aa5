"""Exact Jaccard join of documents' word-shingle sets, by set-relation skipping.

1. Equal sets are one class (128-bit digest); a class goes on as its smallest id.
2. Highly similar classes are found first: each class has a few min-hash keys, and each member of a key's group is held
   against the group's leader only. Linked classes form first components.
3. The exact join: tokens are put in a global order, tokens of many documents last (counts from a count sketch of fixed
   width), and each set is listed under its first n - ceil(0.8 n) + SHARED tokens: two sets that link share SHARED of these
   (or as many as they need to share at all, if fewer). A list
   is sorted by set size; a set is held against those after it until the sizes differ too much, which skips the rest of
   the list in one block, and pairs are skipped by position: what may still follow in both sets can't reach the needed
   overlap. Pairs within a component are skipped, as their answer is known. So are pairs whose parity signatures differ in
   too many bits: a bit is the parity of the tokens that fall on it, hence sets differ in as many tokens at least; and
   pairs with fewer shared tokens.
4. Verification goes by answers of similar sets: candidates y of several sets x of one star are compared with the star's
   leader L once, |L & y|; for each x the answer follows from the few tokens in which it differs,
   |x & y| = |L & y| - |(L - x) & y| + |(x - L) & y|. One pair for two components is verified first; once it links
   them, the other pairs between them need no answer.

No list, leader or component is capped, and no pair that could link different components is left out, so the components
are exact (up to collisions of 64-bit shingle hashes).

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; fewer than SIZE
words are one shingle; equal texts link; repeated rows each get a row; rows with a null id get n_shingles and a null
component; rows that share an id are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import bucketed, stored, table, text_bytes
from tesserae.operators.graph import components

SIZE = 5
#: Sets link when DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
KEYS, KEY_HASHES = 5, 2
#: Tokens of their listed ones that two sets have to share; each costs a listing more for every set.
SHARED = 6
SKETCH_BITS = 20
#: Sets of up to so many tokens carry a parity signature of so many 64-bit words: a quarter of its bits, less four deviations, is
#: about what linked sets of that size differ by. Larger sets carry none, as a signature as long as they need would outweigh the rest.
SIGNED = ((72, 2), (189, 4), (950, 8))
WORDS = SIGNED[-1][1]
_CHUNK = 1 << 12
_U = np.uint64
_SEEDS = W.mix(np.arange(1, KEYS * KEY_HASHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def needed(nx, ny):
    """Least intersection of sets of these sizes that link."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def prefix_size(n):
    """Tokens under which a set of n is listed, all at most."""
    return np.minimum(n, n - -(-NUM * n // DEN) + SHARED)


def _min_hash_keys(s: np.ndarray) -> list[int]:
    mins = np.array([(s * k).min() for k in _SEEDS]).reshape(KEYS, KEY_HASHES)  # s is mixed already
    return [int.from_bytes(hashlib.blake2b(bytes([k]) + m.tobytes(), digest_size=8).digest(), "little", signed=True) for k, m in enumerate(mins)]


def signature(s: np.ndarray) -> np.ndarray:
    """The parity signature of a set: 1, 2, 4, 8 or no words."""
    words = next((w for most, w in SIGNED if len(s) <= most), 0)
    bits = np.bincount(((s >> _U(16)) & _U(max(1, 64 * words) - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view(_U) if words else s[:0]


def _folded(signs: np.ndarray, words: np.ndarray, to: int) -> np.ndarray:
    """Signatures of the given words each as signatures of to words: a parity of half the bits is that of two bits together."""
    signs = signs.copy()
    for w in (8, 4, 2):
        if w > to:
            wide = words >= w
            signs[wide, : w // 2] ^= signs[wide, w // 2 : w]
    return signs[:, :to]


def may_link(nx: np.ndarray, ny: np.ndarray, sx: np.ndarray, sy: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> np.ndarray:
    """Whether sets of sizes nx and ny with these signatures (rows of WORDS words, of which the first wx and wy hold) can link."""
    out, width = np.ones(len(nx), bool), np.minimum(wx, wy)
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(width == w)
        if len(at):
            apart = np.bitwise_count(_folded(sx[at], wx[at], w) ^ _folded(sy[at], wy[at], w)).sum(axis=1).astype(np.int64)
            out[at] = (nx[at] + ny[at] - apart) // 2 >= needed(nx[at], ny[at])
    return out


def _sets(raw: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, buf, offsets in W.chunks(raw):
        w = W.split(buf, offsets)
        for k, s in enumerate(W.shingle_sets(w, w.hashes(), SIZE)):
            yield first + k, s


def summaries(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(id, n, digest, keys) of each document, in the shared folder; and the count sketch of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["id", "n", "digest", "keys", "sketch"], np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            n, digests, keys = [], [], []
            for _, s in _sets(b.column(1)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(_min_hash_keys(s) if len(s) else [])
                np.add.at(counts, (s >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip((n, digests, keys, [None] * len(n)), kinds[1:], strict=True))], names)
        for c in range(0, len(counts), _CHUNK):
            part = counts[c : c + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([None], [c], [None], [None], [part.tobytes()]), kinds, strict=True)], names)

    rows = docs.mapInArrow(run, "id long, n long, digest binary, keys array<long>, sketch binary")
    rows = stored(rows, "sets")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(data.as_py(), np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["n", "sketch"])

    merged = rows.filter("sketch is not null").select("n", "sketch").repartition("n").mapInArrow(total, "n long, sketch binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in merged.collect():  # 8 bytes a cell, whatever the input
        sketch[r["n"] : r["n"] + _CHUNK] = np.frombuffer(r["sketch"], np.uint64)
    return rows.filter("sketch is null").select("id", "n", "digest", "keys"), sketch


def heat(sketch: np.ndarray) -> np.ndarray:
    """A cell's place in the token order: 0 up to four deviations (of a Poisson count) above the mean, then one more for each doubling of the excess."""
    mean = max(1.0, float(sketch.mean()))
    excess = (sketch - mean) / (4 * mean**0.5)
    return np.where(excess > 1, 1 + np.floor(np.log2(np.maximum(1, excess))), 0).astype(np.uint8)


def overlaps(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (x, y) of asked (star, x, y) whose sets link. texts: id, text. A star's leader is its id."""
    # A star's candidates are split by a hash of y once there are many; its leader and members go to each part.
    sizes = asked.groupBy("star").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 4096)).cast("long").alias("parts"))
    asked = asked.join(sizes, "star").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")))
    none = F.array().cast("array<long>")
    leaders = asked.select("star", "part").distinct().select("star", "part", F.lit(0).alias("kind"), F.col("star").alias("id"), none.alias("xs"))
    members = asked.filter("x <> star").select("star", "part", "x").distinct().select("star", "part", F.lit(1).alias("kind"), F.col("x").alias("id"), none.alias("xs"))
    others = asked.groupBy("star", "part", "y", F.pmod(F.xxhash64("x"), F.lit(64)).alias("g")).agg(F.collect_set("x").alias("xs")).select("star", "part", F.lit(2).alias("kind"), F.col("y").alias("id"), "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by star, part and kind."""
        now, leaders_here, members_here = None, [], {}
        for b in batches:
            found_x, found_y = [], []
            stars, parts, kinds, ids = (b.column(k).to_pylist() for k in range(4))
            for i, s in _sets(b.column(5)):
                if (stars[i], parts[i]) != now:
                    now, leaders_here, members_here = (stars[i], parts[i]), [], {}
                if kinds[i] == 0:
                    leaders_here.append(s)
                    members_here.setdefault(ids[i], []).append((0, s[:0], s[:0], len(s), len(leaders_here) - 1))
                elif kinds[i] == 1:
                    lead = leaders_here[0]
                    members_here.setdefault(ids[i], []).append((1, np.setdiff1d(lead, s, True), np.setdiff1d(s, lead, True), len(s), 0))
                else:
                    shared = [len(np.intersect1d(lead, s, True)) for lead in leaders_here]
                    for x in b.column(4)[i].as_py():
                        for _, less, more, n, k in members_here.get(x, ()):
                            common = shared[k] - _count(less, s) + _count(more, s)
                            if DEN * common >= NUM * (n + len(s) - common):
                                found_x.append(x)
                                found_y.append(ids[i])
                                break
            if found_x:
                yield pa.RecordBatch.from_arrays([pa.array(found_x, pa.int64()), pa.array(found_y, pa.int64())], ["x", "y"])

    roles = leaders.unionByName(members).unionByName(others)
    rows = roles.join(texts, "id").select("star", "part", "kind", "id", "xs", text_bytes(F.col("text")).alias("raw"))
    return rows.repartition("star", "part").sortWithinPartitions("star", "part", "kind").mapInArrow(run, "x long, y long")


def _count(some: np.ndarray, s: np.ndarray) -> int:
    """How many of some (sorted) are in s (sorted, not empty)."""
    if not len(some):
        return 0
    return int((s[np.minimum(np.searchsorted(s, some), len(s) - 1)] == some).sum())


def _signs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each signature, and the signatures as rows of WORDS words."""
    column = column.cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) // 8
    width, flat = np.diff(offsets), np.frombuffer(data, _U) if data is not None and data.size else np.zeros(0, _U)
    out = np.zeros((n, WORDS), _U)
    out[np.arange(WORDS)[None, :] < width[:, None]] = flat[offsets[0] : offsets[-1]]
    return width, out


def candidates(listed: DataFrame) -> DataFrame:
    """Pairs (x, y, cx, cy) of different components that share a listed token and may link. listed: rows of listings()."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        token, ident, size, comp = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(4))
        width, sign = (np.concatenate(x) for x in zip(*(_signs(b.column(4)) for b in got), strict=True))
        del got
        names, seen, own = np.unique(ident, return_index=True, return_inverse=True)
        width, sign = width[seen], sign[seen]  # of each set once
        size, at, comp = size >> 32, size & 0xFFFFFFFF, comp + ident
        order = np.lexsort((ident, size, token))
        token, own, size, at, comp = (v[order] for v in (token, own, size, at, comp))
        del ident, order
        # Lists of one token, or of one component, have no answers to give.
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lo, hi = np.minimum.reduceat(comp, edge), np.maximum.reduceat(comp, edge)
        length = np.diff(np.append(edge, len(token)))
        keep = np.repeat(lo != hi, length)
        token, own, size, at, comp = (v[keep] for v in (token, own, size, at, comp))
        comp_of = np.zeros(len(names), np.int64)
        comp_of[own] = comp
        keys: list[np.ndarray] = []
        size_of = np.zeros(len(names), np.int64)
        size_of[own] = size
        left = np.arange(len(token))

        def told() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            x, y = k // len(names), k % len(names)
            need = np.minimum(SHARED, needed(size_of[x], size_of[y]))
            return pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y]), pa.array(comp_of[x]), pa.array(comp_of[y]), pa.array(need), pa.array(n)], ["x", "y", "cx", "cy", "need", "n"])

        held = 0
        for k in range(1, len(token)):
            left = left[left + k < len(token)]
            right = left + k
            # Sizes ascend within a list, so that the first one too large skips all that follow.
            near = (token[left] == token[right]) & (DEN * size[left] >= NUM * size[right])
            left, right = left[near], right[near]
            if not len(left):
                break
            # The first SHARED common tokens of sets that link leave at least this much to come.
            rest = np.minimum(size[left] - at[left], size[right] - at[right])
            good = (comp[left] != comp[right]) & (own[left] != own[right]) & (rest >= needed(size[left], size[right]) - SHARED + 1)
            good = np.flatnonzero(good)
            x, y = left[good], right[good]
            good = good[may_link(size[x], size[y], sign[own[x]], sign[own[y]], width[own[x]], width[own[y]])]
            if len(good):
                a, b = own[left[good]], own[right[good]]
                keys.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
                held += len(a)
                if held > 2_000_000:
                    held = 0
                    yield told()
        if keys:
            yield told()

    found = listed.repartition("token").mapInArrow(pairs, "x long, y long, cx long, cy long, need long, n long")
    # An id with several texts has several sizes: its least need holds.
    return found.groupBy("x", "y").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy"), F.min("need").alias("need"), F.sum("n").alias("n")).filter("n >= need").select("x", "y", "cx", "cy")


def listings(sets: DataFrame, places: np.ndarray) -> DataFrame:
    """(token, id, place, comp, sign) for the first tokens of each set in the global order. sets: id, comp, raw.

    place is n << 32 | position, comp is less the id: small numbers, which a shuffle compresses.
    """
    shared = sets.sparkSession.sparkContext.broadcast(places)  # a byte a cell of the sketch

    def batch(out: list[np.ndarray], signs: list[tuple[bytes, int]]) -> pa.RecordBatch:
        ends = np.cumsum(np.repeat([len(s) for s, _ in signs], [p for _, p in signs]))
        data = b"".join(s * p for s, p in signs)
        sign = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in np.concatenate(out, axis=1)), sign], ["token", "id", "place", "comp", "sign"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for b in batches:
            ids, comps = b.column(0).to_numpy(), b.column(1).to_numpy()
            out: list[np.ndarray] = []
            signs: list[tuple[bytes, int]] = []
            rows = 0
            for i, s in _sets(b.column(2)):
                n = len(s)
                if not n:
                    continue
                p = int(prefix_size(n))
                # Where few tokens are frequent, the order is that of the hashes, with the frequent ones moved back.
                place = where[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.flatnonzero(place == 0)[:p]
                if len(first) < p:
                    first = np.argsort(place, kind="stable")[:p]
                out.append(np.stack([s[first].view(np.int64), np.full(p, ids[i]), (n << 32) + np.arange(p), np.full(p, comps[i] - ids[i])]))
                signs.append((signature(s).tobytes(), p))
                rows += p
                if rows > 200_000:
                    yield batch(out, signs)
                    out, signs, rows = [], [], 0
            if out:
                yield batch(out, signs)

    return sets.mapInArrow(run, "token long, id long, place long, comp long, sign binary")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of each row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows, sketch = summaries(source.select("id", text_bytes(F.col("text")).alias("raw")))
    classes = rows.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    classes = stored(classes, "classes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Texts of the classes' smallest ids, dealt by id once for all the joins below. An id with several texts keeps them all.
    texts, drop_texts = bucketed(source.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts", "id", buckets)

    # Ids in several classes, then first links: members of a key's group against its leader.
    spread = rows.filter("n > 0 and id is not null").select("id", "digest").join(classes.select("digest", "rep"), "digest").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b", "id")
    spread = spread.select("a", "b").unionByName(spread.select("a", F.col("id").alias("b")))
    keyed = classes.select("rep", "n", F.explode("keys").alias("k"))
    lead = keyed.groupBy("k").agg(F.min("rep").alias("star"), F.min_by("n", "rep").alias("star_n"), F.count("*").alias("c")).filter("c > 1")
    asked = keyed.join(lead.drop("c"), "k").filter(f"rep <> star and {DEN} * least(n, star_n) >= {NUM} * greatest(n, star_n)").select("star", F.col("star").alias("x"), F.col("rep").alias("y")).distinct()
    first = stored(overlaps(asked, texts), "first")
    edges = first.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(spread)
    known = stored(components(edges), "known")

    sets = texts.join(known.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"), text_bytes(F.col("text")).alias("raw"))
    found = stored(candidates(listings(sets, heat(sketch))), "candidates")
    # A set's star: its own leader in the first stage, by the smallest one; itself if there is none.
    stars = first.groupBy(F.col("y").alias("x")).agg(F.min("x").alias("star"))
    starred = lambda pairs: pairs.join(stars, "x", "left").select(F.coalesce("star", "x").alias("star"), "x", "y")
    one = found.groupBy("cx", "cy").agg(F.min(F.struct("x", "y")).alias("p")).select("p.x", "p.y")
    second = stored(overlaps(starred(one), texts), "second")
    some = components(edges.unionByName(second.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    named = lambda side: some.select(F.col("node").alias(side), F.col("component").alias(f"new_{side}"))
    rest = found.join(named("x"), "x", "left").join(named("y"), "y", "left").filter("not (coalesce(new_x, x) <=> coalesce(new_y, y))").select("x", "y").join(one, ["x", "y"], "left_anti")
    third = stored(overlaps(starred(rest), texts), "third")
    final = components(some.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(third.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    drop_texts()  # the rest reads stored tables only
    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, "digest", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [md5_number(array_to_string(ws, ' '))]
  ELSE [md5_number(array_to_string(ws[i:i + 4], ' ')) FOR i IN range(1, len(ws) - 3)] END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS h FROM s),
f AS (SELECT h FROM t GROUP BY h HAVING count(*) > 1),
u AS (SELECT t.doc_id, t.h, n.n FROM t JOIN f USING (h) JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT x, y FROM p WHERE 100 * i >= 80 * (nx + ny - i)),
g AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r AS (WITH RECURSIVE c(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, c.reach FROM c JOIN g ON c.node = g.a AND c.reach < g.b) SELECT node, min(reach) AS component_id FROM c GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, r.component_id FROM n JOIN r ON n.doc_id = r.node
"""
