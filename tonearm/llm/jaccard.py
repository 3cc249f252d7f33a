"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct 3-word shingles, as 64-bit hashes. Equal sets form a class, of which one member
goes on. Similar documents are put into groups of bounded size; the matrix tells which tokens a group's members have
between them, so a query set that has too few of its tokens in a group's union cannot have a partner there, and only
groups that pass are opened.

The matrix holds for each document only its prefix: in a fixed order of all tokens (those of a bounded list of very
common ones last) the first tokens, so many that two sets of the wanted similarity share a set number of them, which
grows with the sets. Groups whose unions share fewer, or whose members' sizes lie too far apart, are not tried. Of the
tokens that two groups must share one stands outside the most widespread ones of both, one fewer than must be shared; so
these bring no groups together, they are only counted. The orders change which groups are tried, never which links are
found.

Groups are parts of what is already linked or alike: first every document is compared with the least holder of its
tokens, one for each token, and what these links join is one kin. Members of a kin need not meet, so tokens that only
one kin holds leave the matrix, and a large group of near copies costs no more than its size. Documents without links
go together where two tokens that edits leave alone are the same.

Null and empty texts have empty sets: they link with nothing and are their own component. Repeated rows are one class.
Rows with a null id are left out of links; each is returned with a null component. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import dropped, map_columns, saved, unused
from tonearm.llm.components import components
from tonearm.llm.hashing import word_hashes

#: Tokens in the list of common ones at most (it is sent to all tasks), and the documents a token needs to be there.
COMMON, COMMON_DOCS = 100_000, 16
#: Documents and tokens in a group at most.
GROUP_DOCS, GROUP_TOKENS = 256, 131_072


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, lower-cased in A-Z only; short texts are one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    if len(h) < n:  # the whole sequence, told apart from shingles by its length
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), 1)], np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n: int, percent: int) -> int:
    """Tokens a set of n shares with any set of the wanted similarity, at least."""
    return -(-percent * n // 100)


def shared_least(n: int, percent: int) -> int:
    """How many tokens the prefixes of similar sets have to share: few for small sets, never more than they must."""
    return min(needed(n, percent), 4 + n // 50)


def _set_key(s: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(s.tobytes())


def _signed(x) -> list[int]:
    return x.view(np.int64).tolist()


def classes(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, and the prefix of the set in plain hash order."""

    def run(ids, texts):
        sizes, keys, low = [], [], []
        for t in texts:
            s = shingles(t, n)
            sizes.append(len(s))
            keys.append(_set_key(s))
            low.append(_signed(s[: len(s) - needed(len(s), percent) + 1]))
        return [ids, sizes, keys, low]

    return map_columns(docs, run, "doc_id long, n_shingles long, set_key string, low array<long>")


def _ranked(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the fixed order: what is not common first, by hash."""
    if not len(common) or not len(s):
        return s
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = common[at] == s
    return np.concatenate([s[~late], s[late]])


def _group_of(s: np.ndarray, common: np.ndarray, percent: int) -> list[int]:
    """Two tokens that name a set's group: the least and the greatest, or, where half of the plain prefix is common,
    its two least common ones, for edits leave these alone and near copies of one text thus share few groups."""
    low = s[: len(s) - needed(len(s), percent) + 1]
    if len(common):
        at = np.minimum(np.searchsorted(common, low), len(common) - 1)
        often = low[common[at] == low]
        if 2 * len(often) >= len(low):
            return _signed(often[[0, min(1, len(often) - 1)]])
    return _signed(s[[0, -1]])


def _star(hub: np.ndarray, ids: list[int], sizes: np.ndarray, tokens: np.ndarray, percent: int) -> list[int]:
    """The ids whose sets (sizes, and tokens end to end) are similar to the hub's."""
    hit = hub[np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)] == tokens
    both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), dtype=np.int64)
    return [i for i, n, z in zip(ids, both.tolist(), sizes.tolist(), strict=True) if 100 * n >= percent * (z + len(hub) - n)]


def _links(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """(a, b) links, as stars, between the members of two groups: (ids, sizes, tokens end to end)."""
    sets = [np.split(tokens, np.cumsum(sizes)[:-1]) for _, sizes, tokens in (left, right)]
    unions = [np.unique(tokens) for _, _, tokens in (left, right)]
    open_ = []  # members whose overlap with the other group's union allows a partner there
    for mine, other in ((0, 1), (1, 0)):
        hit = np.isin((left, right)[mine][2], unions[other])
        sizes = (left, right)[mine][1]
        count = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64))
        open_.append([i for i, (c, z) in enumerate(zip(count, sizes, strict=True)) if c >= needed(int(z), percent)])
    if not all(open_):
        return []
    parts = [[sets[k][i] for i in open_[k]] for k in (0, 1)]
    ids = [np.asarray((left, right)[k][0])[open_[k]] for k in (0, 1)]
    sizes = [np.array([len(s) for s in parts[k]], np.float32) for k in (0, 1)]
    shared = np.intersect1d(np.unique(np.concatenate(parts[0])), np.unique(np.concatenate(parts[1])), assume_unique=True)
    inter = np.zeros((len(ids[0]), len(ids[1])), np.float32)
    for c in range(0, len(shared), 16_384):  # columns of the matrix, some at a time
        some = shared[c : c + 16_384]
        a, b = (_incidence(parts[k], some) for k in (0, 1))
        inter += a @ b.T
    union = sizes[0][:, None] + sizes[1][None] - inter
    rows, cols = np.nonzero(100 * inter.astype(np.float64) >= percent * union.astype(np.float64))
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(ids[0][rows].tolist(), ids[1][cols].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent if find(x) != x]


def _incidence(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    m = np.zeros((len(sets), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(tokens, s)
        ok = at < len(tokens)
        at = at[ok]
        m[i, at[tokens[at] == s[ok]]] = 1
    return m


def _shared_by_sizes(percent: int):
    """Tokens that the prefixes of two similar sets share at least, whose sizes are s to z and whose ``shared_least`` is l.

    Beyond the prefix that ends first in the order, sets share no more than the rest of that one, needed - shared_least
    tokens. So of the tokens they must share, by both sizes, all but these stand in both prefixes. That number falls with
    the larger size and grows with the smaller one, while the sizes allow any similarity; else l holds.
    """
    both = F.floor(percent * (F.col("s") + F.col("z")) / (100 + percent))
    least = F.ceil(percent * F.col("z") / 100)
    sharp = both - least + F.least(least, 4 + F.floor(F.col("z") / 50)) - 1
    return F.when(percent * F.col("z") <= 100 * F.col("s"), F.greatest("l", sharp)).otherwise(F.col("l"))


def _least_of_any(size: str, percent: int):
    """Tokens that the prefix of a set of this size shares with that of any similar set, at least: that of the smallest."""
    small = F.ceil(percent * F.col(size) / 100)
    return F.least(F.ceil(percent * small / 100), 4 + F.floor(small / 50)).cast("int")


def _blocks(n: str, w: str):
    """Blocks into which n documents with w tokens are dealt."""
    return F.greatest(F.ceil(F.col(n) / GROUP_DOCS), F.ceil(F.col(w) / GROUP_TOKENS))


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, tokens) of the wanted documents."""

    def run(ids, texts_):
        found = [shingles(t, n) for t in texts_]
        return [ids, [len(s) for s in found], [s.tobytes() for s in found]]

    found = map_columns(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), run, "doc_id long, size int, tokens binary")
    return found.dropDuplicates(["doc_id"])  # of repeated rows one


def _members(m) -> tuple[list[int], np.ndarray, np.ndarray]:
    return [x["doc_id"] for x in m], np.array([x["size"] for x in m]), np.frombuffer(b"".join(x["tokens"] for x in m), np.uint64)


def _kin_edges(live: DataFrame, size: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) between documents and the least holders of their tokens, of those that share some tokens: a table."""
    near = live.where("doc_id <> hub").groupBy("doc_id", "hub", "least").agg(F.count("*").alias("n"))
    star = saved(near.where("2 * n >= least").select("doc_id", "hub").join(size, "doc_id"))
    of_hub = star.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    blocks = saved(of_hub.select("hub", _blocks("n", "w").cast("int").alias("blocks")))
    spread = star.join(blocks, "hub").select("doc_id", "hub", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)").alias("block"))
    hubs = blocks.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seats = saved(spread.unionByName(hubs))
    sets = _sets(texts, seats.select("doc_id").distinct(), n)
    held = seats.join(sets, "doc_id").groupBy("hub", "block").agg(F.collect_list(F.struct("doc_id", "size", "tokens")).alias("m"))

    def linked(hubs_, lists):
        edges = []
        for hub, m in zip(hubs_, lists, strict=True):
            mine = next(x for x in m if x["doc_id"] == hub)
            rest = [x for x in m if x["doc_id"] != hub]
            if rest:
                edges += [(i, hub) for i in _star(np.frombuffer(mine["tokens"], np.uint64), *_members(rest), percent)]
        return [[a for a, _ in edges], [b for _, b in edges]]

    out = saved(map_columns(held.select("hub", "m"), linked, "a long, b long", 64))
    dropped(star, blocks, seats)
    return out


def similar(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links are sets of at least this Jaccard similarity."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = saved(classes(plain, percent, n))
    known = every.where("doc_id is not null and n_shingles > 0")
    first = saved(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    member = saved(known.select("doc_id", "set_key").join(first, "set_key").select("doc_id", "rep"))
    reps = member.where("doc_id = rep").select("doc_id")

    # the fixed order: tokens that many prefixes hold come last; the list is cut at COMMON, most frequent first
    counts = known.join(reps, "doc_id", "left_semi").select(F.explode("low").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    listed = saved(counts.where(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "t").limit(COMMON).select("t"))
    common = np.sort(np.array([r["t"] for r in listed.toLocalIterator()], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(common)
    counted = saved(every.select("doc_id", "n_shingles"))
    dropped(every, first, listed)

    def prefixes(ids, texts):
        prefix, sizes, least, like = [], [], [], []
        for t in texts:
            s = shingles(t, n)
            sizes.append(len(s))
            like.append(_group_of(s, sent.value, percent))
            least.append(shared_least(len(s), percent))
            prefix.append(_signed(_ranked(s, sent.value)[: len(s) - needed(len(s), percent) + least[-1]]))
        return [ids, sizes, least, like, prefix]

    texts = plain.join(reps.hint("merge"), "doc_id", "left_semi")  # one plan at every size: the ids grow with the texts
    prefix = saved(map_columns(texts, prefixes, "doc_id long, size long, least int, alike array<long>, prefix array<long>"))
    rows = prefix.select("doc_id", "least", F.explode("prefix").alias("t"))
    shared = saved(rows.groupBy("t").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).where("n > 1").select("t", "hub"))
    live = saved(rows.join(shared, "t"))
    size = saved(prefix.select("doc_id", "size", "least", F.xxhash64("alike").alias("alike")).distinct())
    dropped(prefix, shared)

    edges = _kin_edges(live, size.select("doc_id", "size"), plain, percent, n)
    root = components(edges)
    rooted = size.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    kin = saved(rooted.withColumn("kin", F.coalesce("root", "doc_id")))
    family = kin.withColumn("family", F.coalesce("root", "alike"))
    family = saved(family.withColumn("band", F.floor(10 * F.log("size"))).select("doc_id", "kin", "size", "least", "family", "band"))

    # groups: blocks of bounded size of each family, of members of like sizes
    weight = family.groupBy("family", "band").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    large = saved(weight.where("n > 1"))
    block = F.pmod(F.xxhash64("doc_id"), F.coalesce(_blocks("n", "w"), F.lit(1)))
    grouped = family.join(large, ["family", "band"], "left").select("doc_id", "kin", "size", "least", F.xxhash64("family", "band", block).alias("g"))
    grouped = saved(grouped)
    about = grouped.withColumn("low", _least_of_any("size", percent)).groupBy("g").agg(
        *(F.min(c).alias(a) for c, a in (("low", "low"), ("least", "l"), ("size", "s"), ("kin", "a"))), F.max("size").alias("z"), F.max("kin").alias("b")
    )
    about = saved(about.select("g", "low", "l", "s", "z", F.expr("if(a = b, a, null)").alias("only")))  # only: the one kin of a group
    spots = live.select("doc_id", "t").join(grouped.select("doc_id", "kin", "g"), "doc_id")
    several = spots.groupBy("t").agg(F.min("kin").alias("a"), F.max("kin").alias("b"), F.count("*").alias("n")).where("a <> b")
    several = saved(several.select("t", "n"))
    held = spots.join(several, "t").groupBy("g").agg(F.sort_array(F.collect_set(F.struct("n", "t"))).alias("x"))  # GROUP_TOKENS at most
    matrix = saved(held.select("g", F.col("x.t").alias("x")).join(about, "g"))
    dropped(live, size, root, kin, family, large, several)
    rare = F.explode(F.slice("x", 1, F.greatest(F.size("x") - F.col("low") + 1, F.lit(0)))).alias("t")
    sides = [matrix.select(rare, *(F.col(c).alias(f"{c}{i}") for c in ("g", "only", "s", "z"))) for i in (1, 2)]
    near = (100 * F.col("z1") >= percent * F.col("s2")) & (100 * F.col("z2") >= percent * F.col("s1"))
    tried = sides[0].join(sides[1], "t").where((F.col("g1") < F.col("g2")) & F.coalesce(F.col("only1") != F.col("only2"), F.lit(True)) & near)
    both = tried.select("g1", "g2").distinct()
    for i in (1, 2):
        both = both.join(matrix.select(*(F.col(c).alias(f"{c}{i}") for c in ("g", "l", "s", "z", "x"))), f"g{i}")
    ends = [F.least(f"{c}1", f"{c}2").alias(c) for c in ("l", "s")] + [F.greatest("z1", "z2").alias("z")]
    enough = both.select("g1", "g2", F.size(F.array_intersect("x1", "x2")).alias("n"), *ends).where(F.col("n") >= _shared_by_sizes(percent))
    mixed = about.where("only is null").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    pairs = saved(enough.select("g1", "g2").unionByName(mixed))
    used = pairs.select(F.col("g1").alias("g")).unionByName(pairs.select(F.col("g2").alias("g"))).distinct()
    wanted = saved(grouped.select("doc_id", "g").join(used, "g", "left_semi"))
    dropped(matrix, grouped, about)
    held = _sets(plain, wanted.select("doc_id"), n).join(wanted, "doc_id")
    block = saved(held.groupBy("g").agg(F.collect_list(F.struct("doc_id", "size", "tokens")).alias("m")))  # GROUP_DOCS at most, or near
    both = pairs.join(block.select(F.col("g").alias("g1"), F.col("m").alias("m1")), "g1")
    both = both.join(block.select(F.col("g").alias("g2"), F.col("m").alias("m2")), "g2")

    def linked(left, right):
        found = []
        for l, r in zip(left, right, strict=True):
            found += _links(_members(l), _members(r), percent)
        return [[x for x, _ in found], [y for _, y in found]]

    across = saved(map_columns(both.select("m1", "m2"), linked, "a long, b long", 64))
    dropped(pairs, wanted, block)
    found = components(edges.unionByName(across))
    roots = member.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left")
    roots = roots.select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    out = counted.join(roots.dropDuplicates(["doc_id"]), "doc_id", "left")
    out = saved(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    dropped(counted, member, edges, across, found)
    sent.destroy()
    return out


def one_of_each(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component, with all their columns.

    Of rows with one id and equal sets one stays. Rows with null ids go where any row with an id has their set; of others
    with equal sets one stays.
    """
    found = similar(docs, percent, n, id_col=id_col, text_col=text_col)
    go = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    h, k, size, r = (unused(docs, x) for x in ("text_hash", "set_key", "set_size", "row"))
    named, nameless = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    again = named.groupBy(id_col).agg(F.count("*").alias(size)).where(F.col(size) > 1).select(id_col)
    again = saved(again.join(go, id_col, "left_anti"))
    out = named.join(go.unionByName(again).hint("merge"), id_col, "left_anti").select(*docs.columns)
    odd = saved(named.join(again, id_col, "left_semi").select(*docs.columns).unionByName(nameless))
    if odd.isEmpty():
        return out

    def keys(df: DataFrame) -> DataFrame:
        texts = df.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
        return classes(texts, percent, n).select(F.col("doc_id").alias(h), F.col("set_key").alias(k), F.col("n_shingles").alias(size)).distinct()

    odd = odd.withColumn(h, F.xxhash64(text_col)).join(keys(odd), h)
    empty = F.col(id_col).isNull() & (F.col(size) == 0)  # linked with nothing
    known = odd.where(F.col(id_col).isNotNull())
    if not nameless.isEmpty():
        strange = odd.where(F.col(id_col).isNull() & (F.col(size) > 0))
        known = known.unionByName(strange.join(keys(named).select(k), k, "left_anti").select(*odd.columns))
    one = known.groupBy(id_col, k).agg(F.min_by(F.struct(*docs.columns), F.coalesce(text_col, F.lit(""))).alias(r)).select(f"{r}.*")
    return out.unionByName(one).unionByName(odd.where(empty).select(*docs.columns))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as x from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w where len(ws) > 2)
      union all select doc_id, array_to_string(ws, ' ') from w where len(ws) in (1, 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, (select min(r.b) from r where r.a = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id
"""
