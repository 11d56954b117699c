"""Similarity join of word-shingle sets by prefix trees, with the groups its links make.

1. Every text gives the set of its shingle hashes and the set's own hash; equal sets are one class.
2. Of x's hashes in ascending order, an l-prefix (a fifth, plus l = a fifth plus one) goes to token partitions.
   Two sets that are alike by 0.8 or more share at least min(l) tokens of their l-prefixes, so a class that
   shares fewer tokens than the least l of any partner with anyone has no link.  Only the others, the
   candidates, go on.
3. Candidates that share their three least tokens in one of ``bands`` orders meet in a group, as alike sets mostly
   do.  A group is a trie over their sets in one global order; each set runs down the trie, sharing the overlap
   of common paths, and leaves a subtree when the remaining lengths can't reach the bound or when it is
   linked to all below already.  Larger groups are split at ``group`` sets, and one set per component of
   them goes into the next round, until none is split or a round finds no link.
4. Completion: what is left are pairs in different components.  A token whose sets are all in one component
   can't join two components, so such tokens come first in the global order, then the others from rare to
   frequent; sets whose prefix has no open token are done.  Pairs that share an open prefix token are checked
   one by one.  No link between different sets is lost, and no group is expanded into its pairs.

Null or wordless texts have the empty set and no links; a null doc_id never is a smallest id; repeated rows and
equal sets share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytes import BASE, LOWER, join_hashes, mix, slices, span_hashes, utf8, words
from .components import components
from .stages import drop, keep

WIDTH, PERCENT = 5, 80
#: Bytes of text per token partition, sets per trie, orders whose least tokens bring candidates together.
PART_BYTES, GROUP, BANDS = 16 << 20, 512, 4
#: Sets in the groups of one task call, about.
BUCKET = 2048
#: Sets a task remembers having sent.
RECENT = 1 << 18
#: Tokens compared at once on the way down a trie.
STRETCH = 64


def shingle_sets(part: pa.RecordBatch, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the hash of each set (0: empty)."""
    buf, off = utf8(part["text"])
    buf = LOWER[buf]
    s, e, word_off = words(buf, off)
    h = span_hashes(buf, s, e)
    grams = join_hashes(h, width)
    sets, ids = [], np.zeros(len(off) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True)):
        if b - a >= width:
            own = np.unique(grams[a:b - width + 1])
        elif b > a:
            value = b - a
            for w in h[a:b].tolist():
                value = (value * BASE + w) & ((1 << 64) - 1)
            own = mix(np.array([value ^ 0x5DEECE66D], np.uint64))
        else:
            own = np.empty(0, np.uint64)
        sets.append(own)
        if len(own):
            ids[i] = np.sum(mix(own ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)
    ids[ids == 0] += np.array([len(x) > 0 for x in sets], np.uint64)[ids == 0]
    return sets, ids


def spare(n, percent: int = PERCENT):
    """How many of n tokens a set may have outside a set it is linked with."""
    return n * (100 - percent) // 100


def prefix_need(n: int, percent: int = PERCENT) -> int:
    """Tokens of its l-prefix a set of n must share with any set it is linked with."""
    return 1 + spare(-(-n * percent // 100), percent)


class _Node:
    __slots__ = ("children", "deep", "ids", "least", "most", "path")

    def __init__(self, path, deep, n):
        self.path, self.deep = path, deep  # tokens of this edge; tokens up to its end
        self.children: dict[int, _Node] = {}
        self.ids: list[int] = []
        self.least = self.most = n  # sizes of the sets below


class Trie:
    """Sets as sorted uint64 arrays; ``links`` finds those linked with a set, but one per component at most."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.sets, self.parent = percent, [], []
        self.root = _Node(np.empty(0, np.uint64), 0, 0)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def insert(self, tokens: np.ndarray) -> int:
        number, n = len(self.sets), len(tokens)
        self.sets.append(tokens)
        self.parent.append(number)
        node, at = self.root, 0
        while True:
            node.least, node.most = (n, n) if node is self.root and not number else (min(node.least, n), max(node.most, n))
            if at == n:
                node.ids.append(number)
                return number
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = _Node(tokens[at:], n, n)
                leaf.ids.append(number)
                node.children[int(tokens[at])] = leaf
                return number
            k = min(len(child.path), n - at)
            differ = np.flatnonzero(child.path[:k] != tokens[at:at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(child.path):  # split the edge
                top = _Node(child.path[:k], at + k, n)
                top.least, top.most = child.least, child.most
                child.path = child.path[k:]
                top.children[int(child.path[0])] = child
                node.children[int(tokens[at])] = top
                child = top
            node, at = child, at + k

    def one_component(self, node: _Node, root: int, cache: dict) -> bool:
        """Whether all sets below are in component ``root``."""
        got = cache.get(id(node))
        if got is not None and self.find(got) == root:
            return True
        stack = [node]
        while stack:
            x = stack.pop()
            if any(self.find(i) != root for i in x.ids):
                return False
            for c in x.children.values():
                got = cache.get(id(c))
                if got is None or self.find(got) != root:
                    stack.append(c)
        cache[id(node)] = root
        return True

    def links(self, tokens: np.ndarray, number: int, cache: dict) -> list[int]:
        """Links of set ``number`` (in the trie) with sets of other components; unites as it goes."""
        n, found = len(tokens), []
        have = self.percent
        stack = [(self.root, 0, 0)]  # node, overlap and own tokens passed before its edge
        while stack:
            node, overlap, passed = stack.pop()
            if node is not self.root and self.one_component(node, self.find(number), cache):
                continue
            # linked with a set of size m if (100 + percent) * overlap >= percent * (n + m)
            need = -(-have * (n + node.least) // (100 + have))
            start, alive = node.deep - len(node.path), True
            for i in range(0, len(node.path), STRETCH):
                edge = node.path[i:i + STRETCH]
                at = np.searchsorted(tokens, edge)
                overlap += int(np.count_nonzero(tokens[np.minimum(at, n - 1)] == edge))
                passed = int(np.searchsorted(tokens, edge[-1], "right"))
                if overlap + min(n - passed, node.most - start - i - len(edge)) < need:
                    alive = False
                    break
            if not alive:
                continue
            for i in node.ids:
                if i != number and (100 + have) * overlap >= have * (n + len(self.sets[i])) and self.find(i) != self.find(number):
                    self.union(i, number)
                    found.append(i)
            if node.children:
                following = node.children.get(int(tokens[passed])) if passed < n else None
                stack += [(c, overlap, passed) for c in node.children.values() if c is not following]
                if following is not None:
                    stack.append((following, overlap, passed))  # the shared path first
        return found


def trie_links(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the same components as all links among ``sets`` do."""
    trie, out, cache = Trie(percent), [], {}
    for x in sets:
        number = trie.insert(x)
        if number:
            cache.clear() if len(cache) > 4096 else None
            out += [(ids[number], ids[i]) for i in trie.links(x, number, cache)]
    return out


def _arrays(col) -> list[np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, ends = col.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _first_pass(docs: DataFrame, parts: int) -> DataFrame:
    """A row per document (doc_id, n, set_id) and packed l-prefixes per slice and token partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for part in slices(batch):
                sets, ids = shingle_sets(part)
                n = pa.array([len(x) for x in sets], pa.int64())
                rows = len(sets)
                yield pa.record_batch({"doc_id": part["doc_id"], "tag": part["tag"], "n": n, "set_id": pa.array(ids.view(np.int64)),
                                       "part": pa.nulls(rows, pa.int64()), "raw": pa.nulls(rows, pa.int64()), "packed": pa.nulls(rows, pa.binary())})
                fresh = [i for i in np.unique(ids, return_index=True)[1].tolist() if len(sets[i]) and int(ids[i]) not in sent]
                if not fresh:
                    continue
                if len(sent) > RECENT:
                    sent.clear()
                sent.update(int(ids[i]) for i in fresh)
                heads = [sets[i][: 2 * spare(len(sets[i])) + 1] for i in fresh]
                token = np.concatenate(heads)
                owner = np.repeat(np.arange(len(fresh), dtype=np.uint16 if len(fresh) < 1 << 16 else np.uint32), [len(x) for x in heads])
                order = np.argsort(token)
                token, owner = token[order], owner[order]
                to = (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                edges = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
                keys, size_of = ids[fresh], np.array([len(sets[i]) for i in fresh], np.int32)
                names, blobs = [], []
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[p], edges[p + 1]
                    own, slot = np.unique(owner[a:b], return_inverse=True)
                    slot = slot.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
                    load = pickle.dumps((np.diff(token[a:b], prepend=np.uint64(0)), slot, keys[own], size_of[own]), protocol=5)
                    names.append(p)
                    blobs.append((len(load), codec.compress(load, asbytes=True)))
                rows = len(names)
                yield pa.record_batch({"doc_id": pa.nulls(rows, pa.int64()), "tag": pa.nulls(rows, pa.int64()), "n": pa.nulls(rows, pa.int64()), "set_id": pa.nulls(rows, pa.int64()),
                                       "part": pa.array(names, pa.int64()), "raw": pa.array([x[0] for x in blobs], pa.int64()), "packed": pa.array([x[1] for x in blobs], pa.binary())})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).mapInArrow(run, "doc_id bigint, tag bigint, n bigint, set_id bigint, part bigint, raw bigint, packed binary")


def _sharing(packed: DataFrame, parts: int) -> DataFrame:
    """set_id of the classes that share enough tokens of their l-prefix with other classes to have a link.

    Token partitions count the shared tokens of each class; the counts go on packed, one string for each of
    ``parts`` ranges of set ids, where they are summed.
    """
    def count(group: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd", 1)
        tokens, owners, sizes = [], [], []
        for p, r in zip(group["packed"].to_pylist(), group["raw"].to_pylist(), strict=True):
            token, owner, keys, n = pickle.loads(codec.decompress(p, r, asbytes=True))
            tokens.append(np.cumsum(token, dtype=np.uint64))
            owners.append(keys[owner])
            sizes.append(n[owner])
        token, owner, n = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
        order = np.argsort(token, kind="stable")
        token, owner, n = token[order], owner[order], n[order]
        edge = np.concatenate([[True], token[1:] != token[:-1], [True]])
        several = ~(edge[:-1] & edge[1:])
        token, owner, n = token[several], owner[several], n[several]
        order = np.lexsort((owner, token))  # a set may come from several tasks: it counts once
        token, owner, n = token[order], owner[order], n[order]
        if len(token):
            once = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
            token, owner, n = token[once], owner[once], n[once]
            edge = np.concatenate([[True], token[1:] != token[:-1], [True]])
            several = ~(edge[:-1] & edge[1:])
            owner, n = owner[several], n[several]
        keys, first, shared = np.unique(owner, return_index=True, return_counts=True)
        to = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        edges = np.searchsorted(to, np.arange(parts + 1, dtype=np.uint64))
        names = np.flatnonzero(np.diff(edges)).tolist()
        loads = [pickle.dumps((keys[edges[p]:edges[p + 1]], shared[edges[p]:edges[p + 1]].astype(np.int32), n[first[edges[p]:edges[p + 1]]]), protocol=5) for p in names]
        return pa.table({"range": pa.array(names, pa.int64()), "raw": pa.array([len(x) for x in loads], pa.int64()), "packed": pa.array([codec.compress(x, asbytes=True) for x in loads], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        loads = [pickle.loads(codec.decompress(p, r, asbytes=True)) for p, r in zip(group["packed"].to_pylist(), group["raw"].to_pylist(), strict=True)]
        keys, shared, n = (np.concatenate(x) for x in zip(*loads, strict=True))
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        shared, n = np.bincount(back, shared), n[first].astype(np.int64)
        return pa.table({"set_id": pa.array(keys[shared >= prefix_need(n)].view(np.int64))})

    counted = packed.groupBy("part").applyInArrow(count, "range bigint, raw bigint, packed binary")
    return counted.groupBy("range").applyInArrow(total, "set_id bigint")


def _sets_of(docs: DataFrame, bands: int) -> DataFrame:
    """set_id, tokens (ascending) and keys (of the three least tokens in each of ``bands`` orders)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, ids = shingle_sets(part)
                keys = np.zeros((len(sets), bands), np.uint64)
                for i, x in enumerate(sets):
                    for k in range(bands if len(x) else 0):
                        h = mix(x ^ np.uint64(0x9E6C63D0876A9A47 * (k + 1) & ((1 << 64) - 1)))
                        low = np.sort(np.partition(h, 2)[:3]) if len(h) > 3 else np.sort(h)
                        keys[i, k] = np.bitwise_xor.reduce(mix(low + np.arange(len(low), dtype=np.uint64))) + np.uint64(k)
                yield pa.record_batch({"set_id": pa.array(ids.view(np.int64)), "tokens": _lists([len(x) for x in sets], np.concatenate(sets) if sets else np.empty(0, np.uint64)),
                                       "keys": _lists([bands] * len(sets), keys.ravel())})

    return docs.select("text").mapInArrow(run, "set_id bigint, tokens array<bigint>, keys array<bigint>")


def _lists(sizes: list[int], flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _tries(groups: DataFrame, buckets: int) -> DataFrame:
    """Links of every group of ``groups`` (key, salt, set_id, tokens); a task call takes a bucket of whole groups."""
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("key", "ascending"), ("salt", "ascending"), ("set_id", "ascending")]).combine_chunks()
        key, salt = bucket["key"].to_numpy(), bucket["salt"].to_numpy()
        ids, sets = bucket["set_id"].to_pylist(), _arrays(bucket["tokens"])
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]), [True]])).tolist()
        found = [p for a, b in zip(edges[:-1], edges[1:], strict=True) for p in trie_links(ids[a:b], sets[a:b])]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key", "salt"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "a bigint, b bigint")


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("set_id"))
    return rows.join(roots, rows["set_id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")


def _group_links(sets: DataFrame, group: int) -> DataFrame | None:
    """Links by rounds of tries over the sets that share a key; None without any."""
    spark, links, roots, turn = sets.sparkSession, None, None, 0
    at = sets.select("set_id", F.explode(F.array_distinct("keys")).alias("key"))
    while True:
        # one set per component and group; groups of one have nothing to find
        member = _with_roots(at, roots).groupBy("key", "root").agg(F.min("set_id").alias("set_id"))
        sized, sizes = keep(member.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        salt = F.pmod(F.xxhash64("set_id", "key", F.lit(turn)), F.ceil(F.col("k") / group))
        dealt = member.join(sized, "key").select("key", salt.alias("salt"), "set_id")
        members = sized.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
        new, path = keep(_tries(dealt.join(sets.select("set_id", "tokens"), "set_id"), 1 + members // BUCKET))
        if new.isEmpty():
            drop(spark, path, sizes)
            return links
        links = new if links is None else links.unionByName(new)
        split = sized.where(F.col("k") > group).select("key")
        if split.isEmpty():
            return links
        at, roots, turn = at.join(split, "key", "left_semi"), components(links), turn + 1


def _completed(sets: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """All links, with those between the components that ``links`` leaves apart."""
    roots = components(links) if links is not None else None
    known, held = keep(_with_roots(sets.select("set_id", F.size("tokens").alias("n"), "tokens"), roots))
    tokens = known.select("set_id", "n", "root", F.explode("tokens").alias("token"))
    opened = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("token").alias("t"), "df")
    of_open = tokens.join(opened, tokens["token"] == opened["t"]).select("set_id", "n", "root", "token", "df")
    left = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1  # length of the prefix; the closed tokens stand first in it
    per = of_open.groupBy("set_id").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("open"))
    prefix = (per.withColumn("take", (left - (F.col("n") - F.size("open"))).cast("int")).where("take > 0")
              .select("set_id", "n", "root", F.posexplode(F.slice("open", 1, F.col("take"))["token"]).alias("at", "token"), (F.col("n") - F.size("open")).alias("closed"))
              .select("set_id", "n", "root", "token", (F.col("n") - F.col("closed") - F.col("at")).alias("rest")))
    rows, held2 = keep(prefix)
    other = rows.select(F.col("token").alias("u"), F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("rest").alias("left"))
    # at its first common token a linked pair still has enough tokens before it on both sides
    enough = F.least("rest", "left") * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT
    pairs = (rows.join(other, (F.col("token") == F.col("u")) & (F.col("root") < F.col("other")) & enough)
             .select(F.col("set_id").alias("a"), "b").distinct())
    pairs, held3 = keep(pairs)
    if pairs.isEmpty():
        drop(sets.sparkSession, held, held2, held3)
        return links
    mine, theirs = (sets.select(F.col("set_id").alias(i), F.col("tokens").alias(t)) for i, t in (("a", "x"), ("b", "y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(_arrays(batch["x"]), _arrays(batch["y"]), strict=True):
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                linked.append((100 + PERCENT) * common >= PERCENT * (len(x) + len(y)))
            yield pa.record_batch({"a": batch["a"], "b": batch["b"]}).filter(pa.array(linked, pa.bool_()))

    new, _ = keep(pairs.join(mine, "a").join(theirs, "b").mapInArrow(run, "a bigint, b bigint"))
    return new if links is None else links.unionByName(new)


def similar_groups(docs: DataFrame, bands: int = BANDS, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and set_id of every row of ``docs``; also
    __tag (hash of the text) and whether the row stands for its group (the least doc_id, nulls last, then the least
    hash; every row without words stands for itself)."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / PART_BYTES))
    first, _ = keep(_first_pass(docs, parts))
    rows = first.where(F.col("set_id").isNotNull()).select("doc_id", "tag", "n", "set_id")
    classes = rows.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"),
                                                             F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("head"))
    sharing = _sharing(first.where(F.col("packed").isNotNull()).select("part", "raw", "packed"), parts)
    candidates, _ = keep(classes.join(sharing, "set_id").select("set_id", "least"))
    one = candidates.select(F.col("least").alias("__id")).distinct()
    # hashed at every size: the texts are neither sorted nor is the plan another one on small inputs
    texts = docs.select("doc_id", "text").join(one.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    found = _sets_of(texts, bands).join(candidates.select("set_id"), "set_id").groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.first("keys").alias("keys"))
    sets, path = keep(found)
    links = _completed(sets, _group_links(sets, group))
    if links is None:
        rooted = classes.withColumn("root", F.col("set_id"))
    else:
        rooted = _with_roots(classes, components(links))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    member = rooted.select("set_id", "root").join(ids, "root").select(F.col("set_id").alias("__set"), "component_id", "head")
    out = rows.join(member, rows["set_id"] == member["__set"], "left")
    drop(spark, path)
    stands = F.col("head").isNull() | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.tag") == F.col("tag")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      "set_id", F.col("tag").alias("__tag"), stands.alias("stands"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of similar rows; rows without words all stay."""
    found = similar_groups(docs).where("stands")
    kept = found.groupBy(F.col("doc_id").alias("__id"), F.col("__tag").alias("__of")).agg(F.max("n_shingles").alias("__n"))
    tagged = docs.withColumn("__tag", F.xxhash64("text")).withColumn("__key", F.coalesce("doc_id", F.lit(-1)))
    on = (F.col("__key") == F.coalesce("__id", F.lit(-1))) & (F.col("__tag") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    alike = Window.partitionBy("__key", "__tag").orderBy(F.lit(0))  # rows equal in id and text: partitioned and sorted so by the join
    rows = tagged.join(kept, on).withColumn("__turn", F.row_number().over(alike))
    return rows.where((F.col("__turn") == 1) | (F.col("__n") == 0)).select(*docs.columns)
