"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

1. `prints`: in one pass over the texts, each document gets the digest of its words, its number of shingles and a signature
   of 128 MinHash symbols of 8 bits. Equal word sequences are one class from here on, with its smallest id for all.
2. Pigeonhole: a signature is split into 16 chunks of 8 symbols. Two signatures at a distance of at most 31 symbols agree in
   some chunk but for one symbol, so each chunk is entered 8 times, once with each symbol left out (the allowed chunk
   errors). All such pairs share a key. At a similarity of 0.8 the expected distance is 26; pairs that lie further apart
   share a key just as often as chance has it, which misses 1.3 pairs in 100,000 at 0.8 exactly and fewer above.
3. `edges`: a key's documents are linked as a star, first within a task, then over all: what has a key in common is one
   tree of as many edges as members, however large. A task's window forwards a key once.
4. Pairs of a document and a hub within a signature distance of 46 (a pair at 0.8 is beyond it once in 100,000) are
   confirmed on the full shingle sets; links make components: a forest in each task, then star steps over all.
5. Keys whose members still lie in different components are done in full, in grids of bounded blocks: each member outside a
   key's largest component meets all others of the key. Components with near members in one key are a family, of which each
   member outside the largest component is confirmed against all members of other components. No partner is dropped: pairs that stay unconfirmed are those within one component already. Tasks hand
   on what joins components, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veriloom.llm.common import discard, place_of, positional, resident, slices, through_table

SYMBOLS, CHUNKS, FARTHEST = 128, 16, 46
WIDTH = SYMBOLS // CHUNKS
_WINDOW_KEYS = 500_000
_WINDOW_LINKS = 500_000
_HUB_ROWS = 64
#: Bounds of a block of a family or a key; a cell compares two blocks.
_BLOCK_ROWS, _BLOCK_BYTES = 1024, 8_000_000
_LARGEST = (1 << 32) - 1


class _WordHashes(dict):
    """64-bit hashes of words, kept for the worker's next texts; bounded, and long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = h
        return h


@lru_cache(1)
def _permutations():
    import numpy as np

    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, SYMBOLS, np.uint32), rng.integers(0, 2**32, SYMBOLS, np.uint32) | np.uint32(1)


def _mixed(x):
    """A bijection of 64-bit integers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], k: int):
    """The distinct shingles of k words as ascending 64-bit hashes; of fewer words, the whole sequence as one."""
    import numpy as np

    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x)


def signature(shingles) -> bytes:
    """The low byte of the least of the shingles under each of SYMBOLS permutations."""
    import numpy as np

    flip, times = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, _LARGEST, np.uint32)
    for at in range(0, len(x), 1024):
        z = (x[at : at + 1024, None] ^ flip) * times
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        np.minimum(least, z.min(0), out=least)
    z = (least ^ (least >> np.uint32(16))) * np.uint32(0x297A2D39)
    return (z >> np.uint32(24)).astype(np.uint8).tobytes()


def chunk_keys(signatures):
    """(n, CHUNKS * WIDTH) 64-bit keys of an (n, SYMBOLS) array of symbols: each chunk with each symbol left out."""
    import numpy as np

    n = len(signatures)
    chunks = signatures.reshape(n, CHUNKS, 1, WIDTH).astype(np.uint64)
    kept = np.repeat(chunks, WIDTH, axis=2)
    kept[:, :, np.arange(WIDTH), np.arange(WIDTH)] = 0
    packed = (kept << (np.arange(WIDTH, dtype=np.uint64) * np.uint64(8))).sum(axis=3, dtype=np.uint64)
    place = _mixed(np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64).reshape(CHUNKS, WIDTH))
    return _mixed(packed ^ place).reshape(n, -1).view(np.int64)


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


def _prints(k: int):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in slices(batches):
            classes, counts, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                words = lowered_words(text)
                shingles = shingle_set(words, k)
                counts.append(len(shingles))
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                signatures.append(signature(shingles) if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], ["id", "class", "n_shingles", "sig"])

    return run


def _local_stars(batches: Iterable) -> Iterator:
    """Of each window of documents, a key's first document as `hub` null, and an edge from it to every later one."""
    import numpy as np
    import pyarrow as pa

    def flush(keys: list, ids: list):
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        hub = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(hub, mask=first), pa.array(doc)], ["key", "hub", "id"])

    keys, ids, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            found = chunk_keys(_matrix(part.column("sig")))
            keys.append(found.ravel())
            ids.append(np.repeat(part.column("id").to_numpy(), found.shape[1]))
            held += found.size
            if held >= _WINDOW_KEYS:
                yield flush(keys, ids)
                keys, ids, held = [], [], 0
    if held:
        yield flush(keys, ids)


def _runs(batches: Iterable) -> Iterator:
    """Edges from a key's first row to its other rows; rows come sorted by key and id."""
    import numpy as np
    import pyarrow as pa

    last_key = last_hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        first = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        run = np.cumsum(first) - 1
        starts = doc[np.flatnonzero(first)]
        hub = np.where(run < 0, last_hub or 0, starts[run] if len(starts) else 0)
        last_key, last_hub = key[-1], hub[-1]
        rest = ~first & (hub != doc)
        if rest.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), pa.array(hub[rest]), pa.array(doc[rest])], ["key", "hub", "id"])


def _near(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            far = (_matrix(batch.column("sig")) != _matrix(batch.column("hub_sig"))).sum(1)
            keep = far <= FARTHEST
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("hub").to_numpy()[keep]), pa.array(batch.column("id").to_numpy()[keep]), pa.array(far[keep], pa.int64())], ["hub", "id", "far"])


def _packed(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in slices(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([pack(t) for t in texts], pa.binary())], ["id", "size", "packed"])


def _similar(a, b, percent: int) -> bool:
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(k: int, percent: int):
    """Rows sorted by (hub, salt) with the hub's own text first: pairs whose full sets are similar enough."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        at, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for hub, salt, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "id", "packed"))):
                shingles = shingle_set(unpack(packed).lower().split(), k)
                if (hub, salt) != at:
                    at, own = (hub, salt), []
                if doc == hub:
                    own.append(shingles)
                elif any(_similar(x, shingles, percent) for x in own):
                    found.append((hub, doc))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], []))], ["hub", "id"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The (hub, id) pairs whose full shingle sets have `percent` of their union in common. A hub's pairs are dealt to tasks
    by salts of some 64 pairs each; `texts` (id, size, packed) moves once for the join and once per pair."""
    degree = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / _HUB_ROWS)).cast("int")
    members = pairs.join(degree, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    hubs = degree.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rows = members.unionByName(hubs).join(texts, "id").withColumn("later", F.col("id") != F.col("hub"))
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "later", "id").select("hub", "salt", "id", "packed")
    return dealt.mapInArrow(_confirm(k, percent), "hub bigint, id bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label): every id of `links` (hub, id) with the smallest id that it is connected to.

    Each task first joins what links it has, a window at a time, so that it hands on a forest. Large-star and small-star steps
    in turn then hang neighbours on the smallest one, until nothing changes. A step is two joins on ids, whose large partitions
    Spark may split, so no node's neighbours need meet in one task; it is written to the shared folder.
    """
    place = F.xxhash64("u").alias("place")  # a join key of its own gives both sides an exchange of their own
    joined = lambda a, b: a.select("*", place).join(b.select("*", place), ["u", "place"]).drop("place")

    def written(pairs: DataFrame) -> tuple[DataFrame, dict]:
        """`pairs` through a table, with their number and the sum of their hashes, taken on the way."""
        seen = Observation()
        marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return through_table(pairs.observe(seen, *marks), "links"), seen.get

    edges, before = written(links.select("hub", "id").where("hub <> id").mapInArrow(_forest, "u bigint, v bigint").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = joined(large, small).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last = edges
        edges, after = written(hung.where("u <> v").distinct())
        discard(last)
        if after == before:
            ends = edges.select(F.col("u").alias("id"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
            labels = through_table(ends, "labels")
            discard(edges)
            return labels
        before = after


def _forest(batches: Iterable) -> Iterator:
    """Of each window of links, an edge from every id to the smallest one that it is connected to."""
    import pyarrow as pa

    def flush():
        edges = [(x, top) for x in sets.over if (top := sets.top(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*edges) if edges else ([], []))], ["u", "v"])

    sets, held = _Sets(), 0
    for batch in batches:
        for u, v in zip(batch.column("hub").to_pylist(), batch.column("id").to_pylist()):
            sets.join(u, v)
        held += batch.num_rows
        if held >= _WINDOW_LINKS:
            yield flush()
            sets, held = _Sets(), 0
    if held:
        yield flush()


class _Sets:
    """Union-find over labels."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.over.get(x, x)) != x:
            self.over[x] = x = self.over.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.over[max(x, y)] = min(x, y)
        return x != y


def _label_forest(left, right):
    """Of members of a key and a block of all of them: label pairs (hub, id) that tie together the labels which have near members."""
    import numpy as np
    import pyarrow as pa

    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        a, b = _matrix(left.column("sig").combine_chunks()), _matrix(right.column("sig").combine_chunks())
        a_label, b_label = left.column("label").to_numpy(), right.column("label").to_numpy()
        sets = _Sets()
        for i in range(len(a)):
            js = np.flatnonzero(b_label != a_label[i])
            for label in np.unique(b_label[js[(b[js] != a[i]).sum(1) <= FARTHEST]]).tolist():
                if sets.join(int(a_label[i]), label):
                    out.append((int(a_label[i]), label))
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], []))], names=["hub", "id"])


def _family_cell(k: int, percent: int):
    def run(left, right):
        """Links (hub, id) between members of two blocks of a family that join labels not joined here so far."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        out: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            unpack = zstandard.ZstdDecompressor().decompress
            read = lambda t: [shingle_set(unpack(x).lower().split(), k) for x in t.column("packed").to_pylist()]
            own = read(left)
            sizes = np.array([len(x) for x in own])
            shingles, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(shingles, kind="stable")
            shingles, owner = shingles[order], owner[order]
            a_id, a_label = left.column("id").to_pylist(), left.column("label").to_numpy()
            sets = _Sets()
            for b_id, b_label, other in zip(right.column("id").to_pylist(), right.column("label").to_pylist(), read(right)):
                lo, hi = np.searchsorted(shingles, other, "left"), np.searchsorted(shingles, other, "right")
                n = hi - lo
                hits = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                both = np.bincount(hits, minlength=len(own))
                similar = (both > 0) & (100 * both >= percent * (sizes + len(other) - both)) & (a_label != b_label)
                for i in np.flatnonzero(similar).tolist():
                    if sets.join(int(a_label[i]), b_label):
                        out.append((a_id[i], b_id))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], []))], names=["hub", "id"])

    return run


def _different(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `edges` (hub, id, ...) whose ends have different labels; an id without a label is its own."""
    marked = edges
    for end in ("hub", "id"):
        marked = marked.join(labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    return marked.where(F.coalesce("hub_label", "hub") != F.coalesce("id_label", "id")).select(*edges.columns)


def _grid(rows: DataFrame, by: str, left_where: str, left_blocks: str, right_blocks: str, *columns: str):
    """Both sides of a grid of (left block, right block) cells within each `by`, for a cogroup."""
    names = [by, *columns]
    cell = lambda side, i, j: side.select(*(F.col(c).alias(c) for c in names), i.alias("i"), j.alias("j"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = cell(rows.where(left_where), dealt(left_blocks), each(right_blocks))
    right = cell(rows, each(left_blocks), dealt(right_blocks))
    return left.groupBy(by, "i", "j").cogroup(right.groupBy(by, "i", "j"))


def family_links(edges: DataFrame, labels: DataFrame, prints: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links (hub, id) that join the components of near documents which share a key, as far as they are joined at all; None
    where there are none.

    Blocks of a key are bounded by rows, those of a family by rows and by bytes of text, so a cell takes as much memory
    whatever the size of its family and the lengths of its texts (one text at least).
    """
    enough = lambda n, b=F.lit(0): F.greatest(F.ceil(n / _BLOCK_ROWS), F.ceil(b / _BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = edges.join(_different(edges, labels).select("key").distinct(), "key", "left_semi")
    members = mixed.select("key", "id").union(mixed.select("key", F.col("hub").alias("id"))).distinct()
    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    # members of a key's largest component are met from the other side
    sized = named.join(sizes, "key").select(
        "key", "id", "label", (F.col("label") != F.col("most.label")).alias("minor"), enough(2 * (F.col("n") - F.col("most.n"))).alias("minor_blocks"), enough(F.col("n")).alias("blocks"))
    rows = through_table(sized.join(prints.select("id", "sig"), "id"), "mixed")
    if rows.isEmpty():
        discard(rows)
        return None
    # through a table: a task of two Python functions takes two workers, which live on and each hold the next operator's memory
    forest = through_table(_grid(rows, "key", "minor", "minor_blocks", "blocks", "id", "label", "sig").applyInArrow(_label_forest, "hub bigint, id bigint"), "key-links")
    tied = components(forest)
    discard(forest)
    families = tied.select(F.col("id").alias("label"), F.col("label").alias("family"))

    of = rows.select("id", "label").distinct().join(families, "label").join(texts.select("id", "size"), "id")
    sizes = of.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("b")).groupBy("family").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.max(F.struct("n", "label", "b")).alias("most"))
    placed = of.join(sizes, "family").select(
        "family", "id", "label", (F.col("label") != F.col("most.label")).alias("minor"), enough(2 * (F.col("n") - F.col("most.n")), F.col("b") - F.col("most.b")).alias("minor_blocks"), enough(F.col("n"), F.col("b")).alias("blocks"))
    family = through_table(placed.join(texts.select("id", "packed"), "id"), "families")
    links = through_table(_grid(family, "family", "minor", "minor_blocks", "blocks", "id", "label", "packed").applyInArrow(_family_cell(k, percent), "hub bigint, id bigint"), "family-links")
    discard(rows, tied, family)
    if links.isEmpty():
        discard(links)
        return None
    return links


def _repeated_ids(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, id): ids whose rows are of several classes, with the first id of each."""
    known = prints.where("class is not null and id is not null").select("id", "class")
    h = F.xxhash64("class")
    several = known.groupBy("id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a <> b").select("id")
    return known.join(several, "id", "left_semi").join(classes, "class").select(F.col("rep").alias("hub"), "id").where("hub <> id")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of distinct `shingle_words`-word shingles have at least `percent` hundredths of
    their union in common; component_id is the smallest id that links reach, kept says that it is the row's own. Words are
    what white space `[\\x20\\x09-\\x0D]` leaves, A-Z in lower case. Texts with fewer words are one shingle; null, empty and
    blank texts have none and are linked with nothing. Rows that repeat an id are one document with several texts: it is
    linked by any of them, and all its rows have its component. A null id has a null component and is linked with nothing.
    Other columns are left out, so their names can't clash.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = through_table(own.mapInArrow(_prints(shingle_words), "id bigint, class binary, n_shingles bigint, sig binary"), "prints")
    classes = prints.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"))
    heads = classes.select(F.col("rep").alias("id"), "class")
    reps = through_table(prints.join(heads, ["id", "class"], "left_semi").select("id", "sig").distinct(), "representatives")

    stars = reps.mapInArrow(_local_stars, "key bigint, hub bigint, id bigint")  # cheaper to make twice than to keep
    firsts = stars.where("hub is null").select("key", "id").repartition("key").sortWithinPartitions("key", "id")
    edges = through_table(firsts.mapInArrow(_runs, "key bigint, hub bigint, id bigint").union(stars.where("hub is not null")), "edges")

    pairs = edges.select("hub", "id").distinct().join(reps, "id").join(reps.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    near = through_table(pairs.select("hub", "id", "sig", "hub_sig").mapInArrow(_near, "hub bigint, id bigint, far bigint"), "near")
    place = F.xxhash64("id").alias("place")  # as below
    met = edges.select("id").union(edges.select(F.col("hub").alias("id"))).distinct().select("id", place)
    packed = own.where("id is not null").mapInArrow(_packed, "id bigint, size bigint, packed binary").select("*", place)
    texts = through_table(packed.join(met, ["id", "place"], "left_semi").drop("place"), "texts")

    links = confirmed(near.select("hub", "id").distinct(), texts, shingle_words, percent).union(_repeated_ids(prints, classes))
    links = through_table(links, "confirmed")
    discard(near)
    labels = components(links)
    if (more := family_links(edges, labels, reps, texts, shingle_words, percent)) is not None:
        first, labels = labels, components(links.union(more))
        discard(first, more)
    discard(reps, edges, texts, links)

    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("label", "rep").alias("component_id"))
    own_class = prints.select(F.col("id").alias("doc_id"), "class", "n_shingles")
    # a join key of its own gives both sides an exchange of their own, whose large partitions Spark may split
    key = F.xxhash64("class").alias("key")
    return own_class.select("*", key).join(of_class.select("*", key), ["class", "key"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document, that with the smallest id, of each group of near duplicates; all columns as they were.

    Groups are those of `near_duplicates`, which says what null, empty, short and very long texts and ties give. Rows that
    repeat an id are one document and stay or go together; rows without an id are in no group and stay. An empty table stays
    empty, and columns may have any names.
    """
    rows, doc, text = positional(docs), place_of(docs, id_col), place_of(docs, text_col)
    id_ = F.col(doc).cast("long")
    # a join key of its own gives both sides an exchange of their own, whose large partitions Spark may split
    place = F.xxhash64("id").alias("place")
    groups = near_duplicates(rows.select(id_.alias("doc_id"), F.col(text).alias("text")), shingle_words, percent)
    stay = groups.where("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct().select("id", place)
    known = rows.where(id_.isNotNull()).withColumn("id", id_).select("*", place).join(stay, ["id", "place"], "left_semi")
    return known.select(*rows.columns).union(rows.where(id_.isNull())).toDF(*docs.columns)
