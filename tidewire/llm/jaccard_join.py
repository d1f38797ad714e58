"""N-gram Jaccard join: size-aware, heavy and light.

A document is the set of its distinct five-word shingles; two link at a Jaccard similarity of 0.8.

1. A set can only link if 80 % of its shingles occur in another document. The hash exchange finds
   these sets; all others are done.
2. Equal sets become one class. All that follows is about classes.
3. Shingles are ordered rarest first. Linked sets of sizes n share c shingles among their first
   n - ceil(0.8 n) + c ones, for every c up to their overlap. Small sets enumerate subsets of the
   fixed size c = 2 of these prefixes; large sets, and small ones that may link to a large one,
   stand in inverted lists (c = 1). The boundary is where the summed cost, counted over all sets by
   size, is least: number of subsets for small ones, length of the lists for large ones.
4. Lists are scanned in steps, so that a list of n mutual copies costs n and not n * n. Every member
   is checked against the centre that most of its lists share: the sets with the smallest share of
   unshared shingles are the centres, and varying ones in further rounds if these do badly. The
   links found join components, and lists inside one component drop out. At last all pairs of
   different components that still share a list are checked, after a bound on sizes and
   positions. A list that is long enough for it by the same costs is replaced by the lists of subsets
   with one shingle more, which linked sets share as well; lists that are long even then are cut into
   blocks. Every check counts the exact intersection.

Links inside a component that are not needed to connect it are not all enumerated: the result is
each document's component, and no link between different components is lost.

Shingles are compared by 64-bit hashes: in a checked pair of n shingles two different ones meet with a
chance below n * n / 2^64.

Defined results: a null text is empty; very long texts are read whole; a set without shingles links to
nothing; rows without an id come after all others; rows that share an id and a text are one node. An
empty table gives no rows. component_ids reads its two columns only; keep_firsts returns every column,
whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import apart, checkpointed, files_for, free_names, map_batches, rolling, small_batches, stored, word_hashes
from tidewire.llm.components import components
from tidewire.llm.exchange import (
    ANSWERS,
    HITS,
    LAST_ID,
    Chunk,
    Question,
    answers,
    bucket_count,
    bucket_of,
    by_document,
    exchanged,
    keyed,
    parted,
)

#: Words of a shingle, and the threshold as a fraction of whole numbers.
WORDS, NUM, DEN = 5, 80, 100
#: Size of the enumerated subsets. Cost of looking at one entry of a list (some nanoseconds inside a
#: join), where a row of the shuffle (some microseconds) costs 1.
SUBSET, SCAN_COST = 2, 0.005
#: Rounds of star checks before all remaining pairs are checked. Another round follows only where so
#: small a share of the checked pairs linked that other centres may do better.
STAR_ROUNDS, GOOD_CENTRES = 4, 0.5
KEY = ["id0", "nul", "th"]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes; of fewer than k words the whole sequence is one shingle."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return np.empty(0, np.uint64)
    if len(h) < k:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    return np.unique(rolling(h, k))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it links to."""
    return -(-NUM * n // DEN)


def prefix(n: int, c: int) -> int:
    return n - least_overlap(n) + c


# --- rarest-first order ---------------------------------------------------------------------


def settle_counts(chunk: Chunk, buckets: int, group: int = 1) -> tuple[list[tuple[int, bytes]], object]:
    """Each distinct hash of the chunk is sent once, with its number of sets; for arrays (hashes) or (hashes, numbers)."""
    owner, hashes, *rest = chunk.flat()
    values, inverse = np.unique(hashes, return_inverse=True)
    count = np.bincount(inverse, rest[0] if rest else None, len(values)).astype(np.int64)
    order, at = parted(bucket_of(values, buckets, group))
    out = [(b, pickle.dumps((order[where], values[order[where]], count[order[where]]), protocol=5)) for b, where in at.items()]
    return out, (owner, hashes, values)


def answer_counts(data: list[bytes]) -> list[object]:
    """(places in the chunk's distinct hashes, sets that have the hash) for each chunk."""
    parts = [pickle.loads(d) for d in data]
    values, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(values)).astype(np.int64)[inverse]
    out, at = [], 0
    for p in parts:
        out.append((p[0], total[at : at + len(p[0])]))
        at += len(p[0])
    return out


def counted(table: pa.Table) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, hashes, sets that have each) of the documents of a chunk."""
    keys, owner, hashes, values = [], None, None, None
    found = []
    for own, data in zip(table.column("own").to_pylist(), table.column("data").to_pylist(), strict=True):
        if own:
            keys, (owner, hashes, values) = pickle.loads(data)
        else:
            found.append(pickle.loads(data))
    if keys:
        df = np.zeros(len(values), np.int64)
        for place, total in found:
            df[place] = total
        own_df = df[np.searchsorted(values, hashes)]
        bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
        for i, key in enumerate(keys):
            yield key, hashes[bounds[i] : bounds[i + 1]], own_df[bounds[i] : bounds[i + 1]]


def conclude_counts(answered: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return answers([(key[0], False, pickle.dumps((key[4], df), protocol=5)) for key, _, df in counted(table)])

    return answered.groupBy("chunk").applyInArrow(run, ANSWERS)


COUNTS = Question(
    settle_counts, answer_counts, lambda row: pickle.loads(row["data"])[1:], lambda row: pickle.loads(row["data"])[:1], settle_counts, answer_counts, conclude_counts
)

PREFIXES = "node long, n long, alone long, tokens binary, df binary"


def rarest_first(table: pa.Table) -> pa.Table:
    """The prefix of each set of a chunk: its shared shingles, rarest first, after `alone` unshared ones; long enough for subsets of one more."""
    rows: list[tuple] = []
    for key, h, d in counted(table):
        shared = d >= 2
        alone, n = int(len(h) - shared.sum()), len(h)
        take = prefix(n, SUBSET + 1) - alone
        if take <= 1 or prefix(n, 1) <= alone:
            continue
        h, d = h[shared], d[shared]
        order = np.lexsort((h, d))[:take]
        rows.append((key[0], n, alone, h[order].tobytes(), d[order].tobytes()))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in PREFIXES.split(", ")]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})


# --- boundary -------------------------------------------------------------------------------


def size_class(n: int) -> int:
    """Geometric classes of sizes: their number is bounded by the logarithm of the largest set."""
    return int(np.floor(np.log(n) / np.log(1.1)))


def boundary(prefixes: DataFrame) -> int:
    """The size from which sets are large. Costs are summed over all sets by class of size."""

    def costs(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[int, list[float]] = {}
        for n, alone, df in zip(batch.column("n").to_pylist(), batch.column("alone").to_pylist(), batch.column("df").to_pylist(), strict=True):
            d = np.frombuffer(df, np.int64)[: prefix(n, SUBSET) - alone]
            c = sums.setdefault(size_class(n), [0.0, 0.0])
            c[0] += len(d) * (len(d) - 1) / 2
            lead = d[: max(0, prefix(n, 1) - alone)]
            c[1] += len(lead) + SCAN_COST * float(lead.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c[0] for c in sums.values()], pa.float64()), pa.array([c[1] for c in sums.values()], pa.float64())],
            names=["size", "small", "large"],
        )

    by_class = map_batches(prefixes, costs, "size int, small double, large double").groupBy("size").agg(F.sum("small"), F.sum("large"))
    rows = sorted(tuple(r) for r in by_class.collect())
    best, at = float("inf"), 1
    for b in [1, *(int(np.ceil(1.1 ** (size + 1))) for size, _, _ in rows)]:
        cost = sum(s for size, s, _ in rows if 1.1**size < b) + sum(w for size, _, w in rows if 1.1 ** (size + 1) > b * NUM / DEN)
        if cost < best:
            best, at = cost, b
    return at


POSTINGS = "key long, node long, n long, place long, small boolean, loose double"


def postings(prefixes: DataFrame, bound: int) -> DataFrame:
    """A row per subset of a small set and per list entry of a large or nearly large one.

    place is the position of the (first) shingle in the rarest-first order; small rows of lists are
    only there for large ones.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[tuple] = []
        for node, n, alone, tokens in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "alone", "tokens")), strict=True):
            t = np.frombuffer(tokens, np.uint64)[: prefix(n, SUBSET) - alone]
            if n < bound:
                i, j = np.triu_indices(len(t), 1)
                if len(i):
                    parts.append((rolling_pair(t[i], t[j]), node, n, alone + i, False, alone / n))
            if n >= bound * NUM / DEN:
                lead = t[: max(0, prefix(n, 1) - alone)]
                if len(lead):
                    parts.append((lead.view(np.int64), node, n, alone + np.arange(len(lead)), n < bound, alone / n))
        if not parts:
            parts.append((np.empty(0, np.int64), 0, 0, np.empty(0, np.int64), False, 0.0))
        lengths = [len(p[0]) for p in parts]
        spread = lambda i, t: pa.array(np.repeat(np.array([p[i] for p in parts]), lengths).astype(t))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([p[0] for p in parts])),
                spread(1, np.int64),
                spread(2, np.int64),
                pa.array(np.concatenate([p[3] for p in parts]).astype(np.int64)),
                spread(4, bool),
                spread(5, float),
            ],
            names=[c.split()[0] for c in POSTINGS.split(", ")],
        )

    return map_batches(prefixes, run, POSTINGS)


def rolling_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, apart from the numbers of single shingles."""
    x = a * np.uint64(0xC2B2AE3D27D4EB4F) + b
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


# --- candidates and checks ------------------------------------------------------------------


def may_link(a: str, b: str) -> str:
    """Bound on sizes and on what is left after the places of a shared shingle."""
    need = f"{NUM} * ({a}n + {b}n)"
    left = f"least({a}n - {a}place, {b}n - {b}place)"
    return (
        f"{DEN} * {a}n >= {NUM} * {b}n and {DEN} * {b}n >= {NUM} * {a}n and {left} * {NUM + DEN} >= {need} "
        f"and not ({a}small and {b}small)"
    )


def with_roots(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings with the root of each row."""
    if roots is None:
        return posts.withColumn("root", F.col("node"))
    return posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def mixed(placed: DataFrame, *facts: Column) -> DataFrame:
    """key and facts of the lists that hold two components or more; a long list is summed up in every task first."""
    return apart(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *facts).filter("lo < hi").drop("lo", "hi"))


def star_pairs(placed: DataFrame, nth: int) -> DataFrame:
    """For each node the centre of another component that most of its lists share: a, b.

    Centres are the least loose sets at first, then ones that vary with the round.
    """
    order = (F.col("loose"), F.col("node")) if nth == 0 else (F.xxhash64("node", F.lit(nth)), F.col("node"))
    centre = mixed(placed, F.min_by(F.struct("node", "n", "place", "small", "root"), F.struct("small", *order)).alias("c"))
    centre = centre.select("key", *(F.col(f"c.{c}").alias(f"c_{c}") for c in ("node", "n", "place", "small", "root")))
    near = placed.join(centre, "key").filter("root <> c_root").filter(may_link("", "c_"))
    shared = near.groupBy("node", "c_node").agg(F.count(F.lit(1)).alias("lists"))
    best = shared.groupBy("node").agg(F.max_by("c_node", F.struct("lists", F.negative("c_node"))).alias("c_node"))
    return best.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()


def narrowed(lists: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The lists with the long ones replaced by those of subsets with one shingle more.

    Linked sets share one more shingle than the key of the list of their first common ones has, and it comes after these
    in both prefixes. So a list can be parted by what comes after its key: a set stands in as many new lists as its prefix
    goes on for. A list is parted where these rows cost less than holding all its rows against each other.
    """
    width = F.ceil(F.col("n") * (DEN - NUM) / DEN) + SUBSET + 1
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("parts"))
    long = checkpointed(sizes.filter(F.col("parts") < SCAN_COST / 2 * F.col("rows") * F.col("rows")).select("key"))
    if long.isEmpty():
        return lists

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, keys = [], []
        for i, (key, n, place, alone, tokens) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "n", "place", "alone", "tokens")), strict=True)):
            t, first = np.frombuffer(tokens, np.uint64), place - alone
            if int(t[first].view(np.int64)) == key:
                more = t[first + 1 : prefix(n, 2) - alone]
            else:
                second = first + 1 + int(np.flatnonzero(rolling_pair(np.repeat(t[first], len(t) - first - 1), t[first + 1 :]) == key)[0])
                more = t[second + 1 : prefix(n, SUBSET + 1) - alone]
            at.append(np.full(len(more), i))
            keys.append(rolling_pair(np.full(len(more), key).view(np.uint64), more))
        joined = np.concatenate([np.empty(0, np.int64), *at]).astype(np.int64)
        rows = batch.select([c for c in batch.schema.names if c not in ("alone", "tokens")]).take(pa.array(joined))
        return rows.set_column(rows.schema.get_field_index("key"), "key", pa.array(np.concatenate([np.empty(0, np.int64), *keys]).astype(np.int64)))

    names = lists.columns
    held = lists.join(apart(long), "key", "left_semi").join(prefixes.select("node", "alone", "tokens"), "node").select(*names, "alone", "tokens")
    parted = map_batches(held, run, lists.schema)
    parted = checkpointed(parted.join(mixed(parted), "key", "left_semi"), parts_for(POSTING_BYTES * lists.count()))
    return lists.join(apart(long), "key", "left_anti").unionByName(parted)


#: Rows of a list that one task holds against as many: longer lists are cut into blocks.
BLOCK = 2000


def in_blocks(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of lists on both sides of a join on key, i, j: a pair of blocks of a long list is a key of its own.

    Every row of a list of b blocks stands once on each side for each of them, so that each pair of rows
    meets once, and no task gets more than a block against a block.
    """
    long = lists.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BLOCK)
    long = checkpointed(long.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    if long.isEmpty():
        whole = lists.withColumns({"i": F.lit(0), "j": F.lit(0)})
        return whole, whole
    rows = lists.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.select(*lists.columns, F.col("own").alias("i"), every.alias("j")), rows.select(*lists.columns, every.alias("i"), F.col("own").alias("j"))


def cross_pairs(lists: DataFrame, checked: DataFrame) -> DataFrame:
    """Unchecked pairs of nodes of different components that share a list and pass the bounds: a, b with a < b."""
    left, right = in_blocks(lists)
    side = lambda rows, name: rows.select("key", "i", "j", *(F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "place", "small", "root")))
    pairs = side(left, "x").join(side(right, "y"), ["key", "i", "j"]).filter("x_node < y_node and x_root <> y_root").filter(may_link("x_", "y_"))
    return pairs.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link: the exact size of the intersection is counted."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("s")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("t")), "b").select("a", "b", "s", "t")
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                every = np.sort(np.concatenate([x, y]))
                common = int((every[1:] == every[:-1]).sum())
                keep.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


#: Bytes of a partition of a scratch table, of an entry of a posting list, and of a prefix for each shingle of its set.
PART_BYTES, POSTING_BYTES, PREFIX_BYTES = 64 << 20, 41, 16 * (DEN - NUM) / DEN


def parts_for(size: float) -> int:
    return max(1, int(size / PART_BYTES) + 1)


def link_classes(sets: DataFrame, buckets: int, files: int, n_shingles: int) -> DataFrame | None:
    """node, root of all linked classes; None if there is no link. sets has node and tokens, n_shingles at most in all."""
    rows = sets.select(F.col("node").alias("id0"), F.lit(False).alias("nul"), F.lit(0).cast("long").alias("th"), "tokens")
    found = exchanged(rows, lambda r: (np.frombuffer(r["tokens"], np.uint64),), COUNTS, buckets)
    prefixes = checkpointed(found.groupBy("chunk").applyInArrow(rarest_first, PREFIXES), parts_for(PREFIX_BYTES * n_shingles))
    posts = stored(postings(prefixes, boundary(prefixes)), "postings")
    roots, checked = None, []
    for nth in range(STAR_ROUNDS):
        pairs = checkpointed(star_pairs(with_roots(posts, roots), nth), files)
        checked.append(pairs)
        roots, found = merged(roots, checkpointed(linked(pairs, sets), files))
        if found >= GOOD_CENTRES * pairs.count():
            break
    placed = with_roots(posts, roots)
    lists = checkpointed(placed.join(mixed(placed), "key", "left_semi"), parts_for(POSTING_BYTES * posts.count()))
    seen = checked[0]
    for pairs in checked[1:]:
        seen = seen.unionByName(pairs)
    rest = checkpointed(cross_pairs(narrowed(lists, prefixes), seen), files)
    return merged(roots, checkpointed(linked(rest, sets), files))[0]


def merged(roots: DataFrame | None, links: DataFrame) -> tuple[DataFrame | None, int]:
    """(node, root of all linked nodes; links found) after more links; they are drawn between roots."""
    found = links.count()
    if not found:
        return roots, 0
    if roots is None:
        return components(links), found
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    over = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    old = over.select("node", F.coalesce("top", "root").alias("root"))
    every = old.unionByName(moved.join(roots, "node", "left_anti"))
    return checkpointed(every, files_for(roots.count() + found)), found


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its key (id0, nul, th), n_shingles and first: the key of its component's first document."""
    rows = keyed(docs, id_col, text_col)
    n_docs = docs.count()
    buckets, files = bucket_count(rows), files_for(n_docs)
    sizes = stored(
        by_document(
            exchanged(rows.select(*KEY, "body"), lambda r: (shingles(r["body"]),), HITS, buckets),
            lambda key, met: (key[3], key[3] > 0 and DEN * len(met) >= NUM * key[3]),
            "n long, open boolean",
        ),
        "set-sizes",
        files,
    )
    open_keys = sizes.filter("open").select(*KEY).distinct()
    n_shingles = sizes.filter("open").agg(F.sum("n")).first()[0] or 0

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(b).tobytes() for b in batch.column(3).to_pylist()]
        sig = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=[*KEY, "sig", "tokens"]
        )

    sets = stored(
        map_batches(rows.join(open_keys, KEY, "left_semi").select(*KEY, "body"), make, "id0 long, nul boolean, th long, sig binary, tokens binary"), "sets"
    )
    classes = stored(
        sets.groupBy("sig")
        .agg(F.min(F.struct("id0", "nul", "th")).alias("first"), F.min("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    roots = link_classes(classes.select("node", "tokens"), max(8, buckets // 4), files, n_shingles)
    named = classes.select("node", "sig", "first")
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        named = named.withColumn("root", F.col("node"))
    firsts = apart(named.groupBy("root").agg(F.min("first").alias("first")))
    of_sig = named.select("sig", "root").join(firsts, "root").select("sig", "first")
    of_doc = sets.select(*KEY, "sig").distinct().join(of_sig, "sig").select(*KEY, "first")
    own = F.struct("id0", "nul", "th")
    return sizes.select(*KEY, "n").join(of_doc, KEY, "left").select(
        *KEY, F.col("n").alias("n_shingles"), F.coalesce("first", own).alias("first")
    )


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    return join_documents(docs, id_col, text_col).select(
        F.when(~F.col("nul"), F.col("id0")).alias(id_col),
        "n_shingles",
        F.when(~F.col("first.nul"), F.col("first.id0")).alias("component_id"),
    )


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each component, with all its columns; repeated rows are reduced to one."""
    found = join_documents(docs, id_col, text_col)
    first = found.filter(F.struct(*KEY) == F.col("first")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"))
    keys = free_names(docs, *KEY)
    first = stored(first.select(*(F.col(c).alias(k) for c, k in zip(KEY, keys, strict=True)), "times"), "firsts", files_for(docs.count()))
    given = F.col(f"`{id_col}`")
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = (F.coalesce(given.cast("long"), F.lit(LAST_ID)), given.isNull(), F.xxhash64(body))
    marked = docs.select("*", *(c.alias(k) for c, k in zip(own, keys, strict=True)))
    kept = marked.join(first.select(*keys), keys, "left_semi")
    if first.filter("times > 1").isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")
    return kept.groupBy(*(F.col(k).alias(c) for c, k in zip(KEY, keys, strict=True))).agg(row).select("row.*")
