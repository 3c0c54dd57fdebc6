"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct SHINGLE-word shingles (with fewer words, the whole sequence), as
64-bit hashes of the words' digests; a set's own digest is 128 bits of BLAKE2b. Different words never
have equal digests by construction (see textkernel); two shingles of compared documents have equal
hashes with a chance of 2**-64. Two documents link when 100 * |x & y| >= 75 * |x | y|.

1. Documents with equal sets form a class; its smallest document stands for it.
2. A linked document shares at least three quarters of its set with one other document. Of the first
   part of its set in hash order, it then shares a known number (see `prefix`), so documents that
   share fewer with all others together are out. This is counted by ranges of hashes, without pairs.
3. Similar documents are partitioned into groups: documents that agree with a pivot in half of their
   minima of residue classes are compared with it, and links give the groups (components so far); this
   is repeated with other pivots for documents whose pivots lie in other groups.
4. The token-group matrix of these groups tells which tokens stand in more than one group. A document
   with a link out of its group has three quarters of its set there; the few that have go on, as
   queries and as members. They are partitioned again, by the minimum that most of them have in common,
   into parts of bounded size whose token unions make the matrix; the rarest tokens of a query, as
   many as it may miss and one more, name the parts it meets; a part is qualifying if the query's
   overlap with its union reaches three quarters of the query, and only qualifying parts are opened,
   that is, compared document by document, for the links that connect groups which the part's other
   links have not.
5. Components of all links.

No step loses a link between documents of different groups; within a group they are connected.
Null and empty texts have empty sets and no links; repeated texts are one class. Every row has a
result row, with the size of its own set; rows with equal doc_id are one document that has the links of
all its texts (a row without words is linked with nothing); a null doc_id counts as the smallest and is
given back as null. An empty table gives an empty one. Only doc_id and text are read; other columns,
whatever their names, are left out (kept by keep_one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm import hashmeet
from strandflow.llm.common import KEY, NO_ID, cut, group_count, key_column, keyed, small_batches
from strandflow.llm.components import components
from strandflow.llm.textkernel import SPACE, chunks, ids_of, long_digests, split_words, window_hash

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 75
#: Residue classes of shingles, each of which gives a minimum, and how many must agree with a pivot's.
CLASSES, AGREE = 8, 4
#: Documents whose tokens one range takes on, and documents of a part of a group.
DOCS_A_RANGE, DOCS_A_PART = 20_000, 512
#: Documents of a group that one copy of its list serves, and parts that a range's documents come in then.
DOCS_A_SLICE, PLACES_A_RANGE = 1024, 8
#: Turns of pivots that groups are made in, and queries that meet a part at a time.
TURNS, DOCS_A_PORTION = 2, 1024


def overlap_of(n: int) -> int:
    """The least overlap that a set of n has with a linked one."""
    return -(-n * SIMILARITY // 100)


def extra(n: int) -> int:
    return max(1, n * 15 // 100)


def prefix(n: int) -> int:
    """Length of the part of a set, in hash order, that shares extra(min(n, m)) tokens with a linked set's.

    Of linked sets x and y with overlap o, the first |x| - o + k and |y| - o + k tokens share k.
    """
    return min(n, n - overlap_of(n) + extra(n))


def needed(n: int) -> int:
    """How many tokens of the prefix a linked set shares at least: its partner has overlap_of(n) tokens or more."""
    return extra(overlap_of(n))


def token_sets(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words = split_words(buf, offsets, SPACE, lower=True)
    hashes = window_hash(words.hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = b - a
        if n >= SHINGLE:
            s = np.sort(hashes[a : b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(window_hash(words.hashes[a:b], n)[:1] if n else np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offsets in chunks(batches):
        sets = token_sets(buf, offsets)
        ends = np.cumsum([8 * len(s) for s in sets])
        signed = long_digests(b"".join([s.tobytes() for s in sets]), np.append(0, ends[:-1]), ends).view(np.int64).T
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(KEY)), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x, pa.int64()) for x in signed]], names=[KEY, "n", "one", "two"])


def _prefixes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets = token_sets(buf, offsets)
    heads = [s[: prefix(len(s))] for s in sets]
    return np.concatenate(heads) if heads else np.zeros(0, np.uint64), np.repeat(np.arange(len(heads)), [len(h) for h in heads])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offsets in chunks(batches):
        sets = token_sets(buf, offsets)
        minima = []
        for s in sets:
            residue = (s % np.uint64(CLASSES)).astype(np.int64)
            at, first = np.unique(residue, return_index=True)
            minima.append([[int(r), int(s[i].view(np.int64))] for r, i in zip(at, first, strict=True)])
        kind = pa.list_(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(KEY)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(minima, kind)], names=[KEY, "n", "tokens", "minima"])


def _common(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs among rows of a, b and their token sets."""
    for batch in batches:
        pairs = []
        for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            both = _common(x, y)
            if 100 * both >= SIMILARITY * (len(x) // 8 + len(y) // 8 - both):
                pairs.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the pairs (a, b); sizes that rule a link out are dropped before."""
    one = sets.select(F.col(KEY).alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("x"))
    two = sets.select(F.col(KEY).alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("y"))
    rows = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b)")
    return rows.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _keys(sets: DataFrame) -> DataFrame:
    """A row per document and residue class: its minimum there."""
    each = sets.select(KEY, F.size("minima").alias("has"), F.explode("minima").alias("m"))
    return each.select(KEY, "has", F.col("m")[0].alias("class"), F.col("m")[1].alias("least"))


def _pivot_pairs(keys: DataFrame, groups: DataFrame | None, turn: int) -> DataFrame:
    """Each document with the pivots of other groups that it agrees with in AGREE minima (or in all it has but one).

    The documents with a common minimum have one pivot, another one in each turn, so pairs follow the documents.
    """
    if groups is not None:
        keys = keys.join(groups, KEY, "left").withColumn("grp", F.coalesce("grp", KEY))
    else:
        keys = keys.withColumn("grp", F.col(KEY))
    pivot = F.min_by(F.struct(F.col(KEY).alias("pivot"), F.col("grp").alias("pivot_grp")), F.xxhash64(KEY, F.lit(turn)))
    pivots = keys.groupBy("class", "least").agg(pivot.alias("p"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("class", "least", "p.*")
    pivots = cut(pivots)  # a join with a table of its own, which Spark broadcasts or splits where a minimum is hot
    met = keys.join(pivots, ["class", "least"]).where("grp <> pivot_grp").groupBy(KEY, "pivot").agg(F.count("*").alias("agree"), F.first("has").alias("has"))
    return met.where(f"agree >= least({AGREE}, greatest(1, has - 1))").select(F.col(KEY).alias("a"), F.col("pivot").alias("b"))


def _groups(sets: DataFrame) -> DataFrame:
    """KEY and grp of documents with links to pivots, after a few turns; fewer if a turn finds no link."""
    keys, links, groups = cut(_keys(sets)), None, None
    for turn in range(TURNS):
        found = cut(_compare(_pivot_pairs(keys, groups, turn), sets))
        if not found.take(1):
            break
        links = found if links is None else links.unionByName(found)
        groups = cut(components(links).select(F.col("node").alias(KEY), F.col("component").alias("grp")))
    return groups if groups is not None else sets.where("false").select(KEY, F.col(KEY).alias("grp"))


def _set_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        sets = [np.frombuffer(t, np.uint64) for t in batch.column(1).to_pylist()]
        if sets:
            yield np.concatenate(sets), np.repeat(ids_of(batch, KEY), [len(s) for s in sets])


def _crossing(buckets: int):
    """Documents three quarters of whose tokens other groups have too, with these tokens, from some groups' slices and lists."""

    def run(documents: pa.Table, lists: pa.Table) -> pa.Table:
        known = {g: np.frombuffer(c, np.uint64) for g, c in zip(lists.column("grp").to_pylist(), lists.column("cross").to_pylist(), strict=True)}
        out = []
        rows = zip(*(documents.column(c).to_pylist() for c in (KEY, "n", "tokens", "grp")), strict=True)
        for key, n, tokens, group in rows if known else ():
            if group in known:
                mine = np.frombuffer(tokens, np.uint64)
                _, short = hashmeet.token_of(mine, buckets)
                mine = mine[np.isin(short, known[group])]
                if len(mine) >= overlap_of(n):
                    out.append((key, n, tokens, group, mine.view(np.int64).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=[KEY, "n", "tokens", "grp", "crossing"])

    return run


def _crossing_documents(sets: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """Documents with a query's chance out of their group; a group's list goes once to each DOCS_A_SLICE of its documents."""
    grouped = sets.select(KEY, "n", "tokens").join(groups, KEY, "left").withColumn("grp", F.coalesce("grp", KEY))
    lists = hashmeet.shared(grouped.select(F.col("grp").alias(KEY), "tokens"), _set_entries, buckets, counts_only=False)
    slices = F.coalesce(F.ceil(F.col("docs") / DOCS_A_SLICE).cast("long"), F.lit(1).cast("long"))
    sizes = cut(groups.groupBy("grp").agg(F.count("*").alias("docs")).where(F.col("docs") > DOCS_A_SLICE))  # the others are one slice
    place = F.pmod(F.xxhash64("grp", "slice"), F.lit(buckets * PLACES_A_RANGE)).alias("place")
    documents = grouped.join(sizes, "grp", "left").withColumn("slice", F.pmod(F.xxhash64(KEY), slices)).select(place, KEY, "n", "tokens", "grp")
    lists = lists.select(F.col(KEY).alias("grp"), F.col("packed").alias("cross")).join(sizes, "grp", "left")
    lists = lists.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).select(place, "grp", "cross")
    return documents.groupBy("place").cogroup(lists.groupBy("place")).applyInArrow(_crossing(buckets), f"{KEY} long, n long, tokens binary, grp long, crossing array<long>")


def _open(key: tuple, queries: pa.Table, members: pa.Table) -> pa.Table:
    """The bound, a query's overlap with a part's token union; a qualifying part is opened until a link is found."""
    links: list[tuple[int, int]] = []
    above: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while root in above:
            root = above[root]
        while x != root:
            above[x], x = root, above[x]
        return root

    names, groups = members.column("b").to_pylist(), np.array(members.column("grp").to_pylist(), np.int64)
    sets = [np.frombuffer(t, np.uint64) for t in members.column("tokens").to_pylist()]
    if sets:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        union = np.unique(every)
        size = np.array([len(s) for s in sets])
        for a, own, tokens in zip(*(queries.column(c).to_pylist() for c in ("a", "grp", "tokens")), strict=True):
            mine = np.frombuffer(tokens, np.uint64)
            if (union[np.minimum(np.searchsorted(union, mine), len(union) - 1)] == mine).sum() < overlap_of(len(mine)):
                continue
            lo, hi = np.searchsorted(every, mine), np.searchsorted(every, mine, side="right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
            linked = np.flatnonzero((100 * both >= SIMILARITY * (len(mine) + size - both)) & (groups != own))
            for i in linked:
                x, y = find(own), find(groups[i])
                if x != y:
                    above[x] = y
                    links.append((a, names[i]))
    return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _links_across(sets: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """Links between documents of different groups; `groups` has KEY and grp for grouped documents."""
    some = cut(_crossing_documents(sets, groups, buckets))
    # similar documents: those that share the minimum which most of them have, in parts of bounded size
    keys = _keys(sets.join(some.select(KEY), KEY, "left_semi"))
    heap = cut(keys.groupBy("class", "least").agg(F.count("*").alias("docs")))
    largest = F.max_by(F.struct("class", "least", "docs"), F.struct("docs", "class", "least"))
    chosen = keys.join(heap, ["class", "least"]).groupBy(KEY).agg(largest.alias("h"))
    number = F.pmod(F.xxhash64(KEY), F.ceil(F.col("h.docs") / DOCS_A_PART).cast("long"))
    some = cut(some.join(chosen.select(KEY, "h.class", "h.least", number.alias("number")), KEY))
    part = ["class", "least", "number"]
    matrix = some.select(*part, "grp", F.explode("crossing").alias("token")).groupBy(*part, "token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    frequency = matrix.groupBy("token").agg(F.count("*").alias("df"))
    asked = some.select(KEY, "n", F.col("grp").alias("own"), F.size("crossing").alias("crossed"), F.explode("crossing").alias("token")).join(frequency, "token")
    # of n tokens n - overlap may be missed, and those that no other group has are missed already
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy("df", "token"))
    asked = asked.withColumn("rank", rank).where(F.col("rank") <= F.expr(f"crossed - (n * {SIMILARITY} + 99) div 100 + 1"))
    met = asked.select(KEY, "own", "token").join(matrix, "token").where("lo <> own OR hi <> own").select(KEY, *part).distinct()
    met = cut(met)
    # a part's queries come in portions of bounded size, each with the part's members
    portions = F.greatest(F.lit(1), F.ceil(F.count("*") / DOCS_A_PORTION)).cast("long").alias("portions")
    asked_of = cut(met.groupBy(*part).agg(portions))
    queries = met.join(asked_of, part).withColumn("portion", F.pmod(F.xxhash64(KEY), "portions")).drop("portions")
    queries = queries.join(some.select(KEY, "grp", "tokens"), KEY).select(*part, "portion", F.col(KEY).alias("a"), "grp", "tokens")
    members = some.select(*part, F.col(KEY).alias("b"), "grp", "tokens").join(asked_of, part)
    members = members.select(*part, F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"), "b", "grp", "tokens")
    by = [*part, "portion"]
    return queries.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(_open, "a long, b long")


def classes(documents: DataFrame) -> DataFrame:
    """KEY, n (set size), component: the smallest KEY reachable by links, itself included."""
    small_batches(documents.sparkSession)
    buckets = group_count(documents, DOCS_A_RANGE)
    texts = keyed(documents, "text")
    sets = cut(texts.mapInArrow(_sets, f"{KEY} long, n long, one long, two long"))
    first = sets.where("n > 0").groupBy("n", "one", "two").agg(F.min(KEY).alias("rep"))
    shares = hashmeet.shared(texts, hashmeet.text_hashes(_prefixes), buckets, counts_only=True)
    reps = first.select(F.col("rep").alias(KEY), "n")
    need = f"greatest(1, ((n * {SIMILARITY} + 99) div 100) * 15 div 100)"
    alive = reps.join(shares, KEY).where(f"n_shared >= {need}").select(KEY)
    tokens = cut(texts.join(alive.distinct().hint("shuffle_hash"), KEY).mapInArrow(_tokens, f"{KEY} long, n long, tokens binary, minima array<array<long>>"))
    groups = _groups(tokens)
    across = cut(_links_across(tokens, groups, buckets))
    # a doc_id of several rows belongs to the classes of them all
    several = cut(sets.groupBy(KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(KEY))
    ties = sets.join(several, KEY, "left_semi").join(first, ["n", "one", "two"]).select(F.col(KEY).alias("a"), F.col("rep").alias("b"))
    every = components(across.unionByName(groups.select(F.col(KEY).alias("a"), F.col("grp").alias("b"))).unionByName(ties))
    every = first.join(every, F.col("rep") == F.col("node"), "left").select("n", "one", "two", F.coalesce("component", "rep").alias("component"))
    out = sets.join(every, ["n", "one", "two"], "left")
    return out.select(KEY, "n", F.coalesce("component", KEY).alias("component"))


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every document."""
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes(documents).select(null(KEY).alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are the smallest of their component."""
    kept = classes(documents).where(f"{KEY} = component").select(F.col(KEY).alias("__kept")).distinct()
    return documents.join(kept, key_column() == kept["__kept"], "left_semi")
