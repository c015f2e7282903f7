"""New batches deduplicated against all accepted history, without reprocessing it.

Multi-key sorted-neighbourhood runs. An accepted row is persisted under several sort keys: its domain, its page, and
its name with its city and with its phone. Keys are sorted by their hash, so that ranges of keys are even whatever the
keys look like; a run is a folder with one sorted part a range. A new batch is sorted by the same keys, split into the
same ranges and merged with the runs of these ranges alone. A window holds the entries of one key around new records;
only what stands in a window of a new record is compared. Every few batches the runs are merged into one, with as many
ranges as their size demands.

What tells a shared host or page from a company's own is kept as counts that can be added up: how often a key came with
a name. A batch is judged by what was known when it arrived, itself included; nothing of later batches is looked at.

Within a batch acceptance follows the order of arrival: a row is accepted when no earlier accepted row matches it. That
is settled in rounds over the rows that share a key: rows without an earlier undecided rival are accepted, what matches
them is rejected, until none is left. No group is ever collected, and exact copies are collapsed before any join.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import keys as K
from lodestrata.session import Scratch, read_text, remove, scratch, stored, tidy, write_text

SHARED_NAMES = 3
COMPACT_EVERY = 3
RANGE_ROWS = 200_000  # entries that a range of keys should hold
FEW_RANGES = 4  # so few are read without asking which of them a batch touches
PROFILE = ["dkey", "lkey", "name", "city", "phone"]
COLUMNS = ["record_id", *PROFILE]
ENTRY = "key bigint, record_id bigint, dkey string"
COUNT = "key bigint, name bigint, n bigint, own int"


def normalised(rows: DataFrame) -> DataFrame:
    """record_id, batch and the comparable forms of a row's attributes; path is what follows its host."""
    return rows.where("record_id IS NOT NULL").select(
        F.col("record_id").cast("bigint").alias("record_id"), K.host(F.col("domain")).alias("dkey"), K.page(F.col("linkedin_url")).alias("lkey"), K.name_key(F.col("company_name")).alias("name"),
        K.place_key(F.col("city")).alias("city"), K.phone_key(F.col("phone")).alias("phone"), K.first_path(F.col("domain")).alias("path"), "batch",
    )


def hashed(kind: str, *parts: Column) -> Column:
    """The sort key of a kind; null where a part is."""
    told = parts[0].isNotNull()
    for p in parts[1:]:
        told = told & p.isNotNull()
    return F.when(told, F.xxhash64(F.lit(kind), *parts))


def places() -> Column:
    """The city and the phone of a row, as far as known."""
    return F.array_compact(F.array(F.concat(F.lit("c:"), F.col("city")), F.concat(F.lit("p:"), F.col("phone"))))


def exact_keys() -> Column:
    """The keys by which rows are the same without further ado: domain and page."""
    return F.array_compact(F.array(hashed("d", F.col("dkey")), hashed("l", F.col("lkey"))))


def node_keys(domain: str) -> Column:
    """The keys of a row's name, place and a domain, by each place."""
    none = F.array().cast("array<bigint>")
    return F.when(F.col("name").isNotNull() & F.col(domain).isNotNull(), F.transform(places(), lambda p: F.xxhash64(F.lit("n"), "name", p, domain))).otherwise(none)


def window_keys() -> Column:
    """The keys of a row's name and place, in whose window almost equal domains may stand."""
    none = F.array().cast("array<bigint>")
    return F.when(F.col("name").isNotNull() & F.col("dkey").isNotNull(), F.transform(places(), lambda p: F.xxhash64(F.lit("w"), "name", p))).otherwise(none)


def almost(x: Column, y: Column) -> Column:
    """Whether a domain is almost another: one edit or swap apart, or alike but for the public suffix."""
    return F.coalesce((x != y) & ((K.stem(x) == K.stem(y)) | K.one_apart(x, y)), F.lit(False))


def shortened(domain: Column) -> Column:
    """What almost equal domains have in common: the stem, or the domain short of one letter."""
    return F.concat(F.array(F.concat(F.lit("*"), K.stem(domain))), K.one_deletions(domain))


def almost_equal(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """on, dkey (of left), other (of right): the almost equal domains with the same columns on, each pair once.

    Domains meet by what they have in common, so even a window that holds a third of all rows compares few.
    """
    a = left.select(*on, "dkey").distinct().select(*on, "dkey", F.explode(shortened(F.col("dkey"))).alias("short"))
    b = right.select(*on, F.col("dkey").alias("other")).distinct().select(*on, "other", F.explode(shortened(F.col("other"))).alias("short"))
    return a.join(b, [*on, "short"]).select(*on, "dkey", "other").distinct().where(almost(F.col("dkey"), F.col("other")))


class Runs:
    """Sorted runs below a folder, each split into 2**bits ranges of its key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.held: list[tuple[str, int]] = []

    @staticmethod
    def range_of(bits: int) -> Column:
        return F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)

    def add(self, df: DataFrame, bits: int) -> None:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        ranged = df.withColumn("range", self.range_of(bits))
        ranged.repartition(max(1, 2**bits), "range").sortWithinPartitions("range", "key").write.partitionBy("range").parquet(path)
        self.held.append((path, bits))

    def all(self) -> DataFrame | None:
        """Everything held."""
        return self.touching(None)

    def touched(self, keys: DataFrame) -> set[int] | None:
        """The ranges, by the finest division held, in which keys fall; None for all. At most 2**bits numbers."""
        bits = max((b for _, b in self.held), default=0)
        if 2**bits <= FEW_RANGES:
            return None
        return {r[0] for r in keys.select(self.range_of(bits)).distinct().collect()}

    def touching(self, ranges: set[int] | None) -> DataFrame | None:
        """What is held in the given ranges; no other range is read."""
        out, finest = None, max((b for _, b in self.held), default=0)
        for path, bits in self.held:
            df = self.spark.read.schema(f"{self.schema}, range int").parquet(path)
            if ranges is not None:
                df = df.where(F.col("range").isin(sorted({r >> (finest - bits) for r in ranges})))
            df = df.drop("range")
            out = df if out is None else out.unionByName(df)
        return out

    def replace(self, df: DataFrame, bits: int) -> None:
        """Merges all runs into one, df, then removes them."""
        old, self.held = self.held, []
        self.add(df, bits)
        for path, _ in old:
            remove(self.spark, path)


class History:
    """The accepted rows and the counts of names by key, below folder (by default a fresh one in the shared folder)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, range_rows: int = RANGE_ROWS):
        self.spark, self.range_rows = spark, range_rows
        self.folder = folder or scratch(spark, "history")
        self.entries = Runs(spark, f"{self.folder}/entries", ENTRY)
        self.counts = Runs(spark, f"{self.folder}/counts", COUNT)
        self.bits, self.compactions = 0, 0
        self.load()

    def load(self) -> None:
        """Takes up a history that an earlier process left in the folder."""
        noted = read_text(self.spark, f"{self.folder}/manifest.json")
        if noted:
            last = json.loads(noted)
            self.bits, self.compactions = last["bits"], last["compactions"]
            self.entries.held, self.counts.held = [tuple(r) for r in last["entries"]], [tuple(r) for r in last["counts"]]

    def save(self) -> None:
        """Notes which runs are valid; a batch counts from here on."""
        noted = {"bits": self.bits, "compactions": self.compactions, "entries": self.entries.held, "counts": self.counts.held}
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(noted))

    def compact(self) -> None:
        """Merges the runs into one each; ranges become as many as the entries demand."""
        held = self.entries.all()
        self.bits = max(0, (max(1, held.count()) // self.range_rows).bit_length())
        self.entries.replace(held, self.bits)
        counts = self.counts.all().groupBy("key", "name").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        self.counts.replace(counts, self.bits)
        self.compactions += 1


def key_counts(rows: DataFrame) -> DataFrame:
    """key, name, n, own: how often hosts and pages stand by a name; own: with a path below the host that spells it."""
    own = F.coalesce((F.length("path") >= 4) & F.col("path").startswith(F.substring("name", 1, 4)), F.lit(False)).cast("int")
    each = F.array(F.struct(hashed("d", F.col("dkey")).alias("key"), own.alias("own")), F.struct(hashed("l", F.col("lkey")).alias("key"), F.lit(0).alias("own")))
    k = rows.select(hashed("name", F.col("name")).alias("name"), F.explode(each).alias("k")).where("k.key IS NOT NULL")
    return k.groupBy("k.key", "name").agg(F.count("*").alias("n"), F.max("k.own").alias("own"))


def shared_keys(counts: DataFrame) -> DataFrame:
    """The keys of hosts and pages that unrelated companies share: they identify nobody.

    A key is shared when it stands by three names or more and these are at least half of its rows, or by two
    names of which one has its own page below the host.
    """
    names = counts.groupBy("key", "name").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    total = names.groupBy("key").agg(F.sum("n").alias("n"), F.count("name").alias("names"), F.max("own").alias("own"))
    return total.where(f"(names >= {SHARED_NAMES} AND 2 * names >= n) OR (names >= 2 AND own = 1)").select("key")


def without_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows with null in place of shared keys. Joins, as the number of shared keys has no bound."""
    for kind, column in (("d", "dkey"), ("l", "lkey")):
        some = shared.select(F.col("key").alias("gone"))
        rows = rows.join(some, hashed(kind, F.col(column)) == F.col("gone"), "left").withColumn(column, F.when(F.col("gone").isNull(), F.col(column))).drop("gone")
    return rows


def history_pairs(new: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): b of the new rows matches an accepted a of the history that stands in a window of one of b's keys."""
    exact = new.select(F.col("record_id").alias("b"), F.explode(exact_keys()).alias("key")).join(held.where("dkey IS NULL"), "key")
    mine = new.select(F.col("record_id").alias("b"), "dkey", F.explode(window_keys()).alias("key"))
    theirs = held.where("dkey IS NOT NULL").join(mine.select("key").distinct(), "key", "left_semi")
    close = almost_equal(mine, theirs, "key")
    near = mine.join(close, ["key", "dkey"]).join(theirs.select("key", F.col("dkey").alias("other"), "record_id"), ["key", "other"])
    return exact.select(F.col("record_id").alias("a"), "b").unionByName(near.select(F.col("record_id").alias("a"), "b")).distinct()


def own_and_asked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(record_id, key): the keys a row stands for, and the keys by which an earlier row repels it."""
    named = rows.where("dkey IS NOT NULL AND name IS NOT NULL").select("name", "dkey").distinct()
    many = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    some = named.join(many, "name", "left_semi")
    close = almost_equal(some, some, "name")
    own = rows.select("record_id", F.explode(F.concat(exact_keys(), node_keys("dkey"))).alias("key"))
    near = rows.join(close, ["name", "dkey"]).select("record_id", F.explode(node_keys("other")).alias("key"))
    return own, rows.select("record_id", F.explode(exact_keys()).alias("key")).unionByName(near)


def settle(ids: DataFrame, own: DataFrame, asked: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The accepted among ids (record_id), by order of arrival. own and asked: see own_and_asked.

    Rows that share no key with others are accepted at once; rounds go over the others alone.
    """
    first = own.groupBy("key").agg(F.min("record_id").alias("first"))
    behind = stored(asked.join(first, "key").where("first < record_id").select("record_id").distinct(), "behind")
    accepted = [ids.join(behind, "record_id", "left_anti")]
    # What the rest is up against: the keys of those that are accepted and of those that are undecided.
    asking = asked.join(behind, "record_id", "left_semi")
    todo, now = behind, accepted[0]
    for _ in range(max_rounds):
        taken = own.join(now, "record_id", "left_semi").select("key", F.col("record_id").alias("a"))
        gone = asking.join(taken, "key").where("a < record_id").select("record_id").distinct()
        left = stored(todo.join(gone, "record_id", "left_anti"), "todo")
        if not left.take(1):
            break
        own_left = own.join(left, "record_id", "left_semi")
        first = own_left.groupBy("key").agg(F.min("record_id").alias("first"))
        blocked = asking.join(left, "record_id", "left_semi").join(first, "key").where("first < record_id").select("record_id").distinct()
        now = stored(left.join(blocked, "record_id", "left_anti"), "accepted")
        accepted.append(now)
        todo = left.join(now, "record_id", "left_anti")
    else:
        raise RuntimeError(f"rows are still undecided after {max_rounds} rounds")
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out


def add_batch(history: History, rows: DataFrame) -> DataFrame:
    """record_id_a, record_id_b of the batch's repeats; the batch's accepted rows and counts join the history.

    rows: normalised rows, one a record_id, all arriving after the history.
    """
    pad = Scratch(history.spark)
    counts = key_counts(rows)
    ranges = history.counts.touched(counts)
    known = history.counts.touching(ranges)
    if known is not None:
        known = known.join(counts.select("key").distinct(), "key", "left_semi").unionByName(counts)
    keyed = without_shared(rows, shared_keys(counts if known is None else known)).where("dkey IS NOT NULL OR lkey IS NOT NULL").select(*COLUMNS)
    keyed = pad.stored(keyed, "keyed")
    reps = keyed.groupBy(*PROFILE).agg(F.min("record_id").alias("record_id")).select(*COLUMNS)
    old = None
    if history.entries.held:
        asked_for = keyed.select(F.explode(F.concat(exact_keys(), window_keys())).alias("key"))
        old = pad.stored(history_pairs(keyed, history.entries.touching(history.entries.touched(asked_for))), "old-pairs")
        reps = reps.join(old.select(F.col("b").alias("record_id")).distinct(), "record_id", "left_anti")
    own, asked = own_and_asked(keyed)
    asked, ids = pad.stored(asked, "asked"), pad.stored(reps.select("record_id"), "reps")
    accepted = pad.stored(settle(ids, own.join(ids, "record_id", "left_semi"), asked.join(ids, "record_id", "left_semi")), "all-accepted")
    rest = asked.join(accepted, "record_id", "left_anti").select(F.col("record_id").alias("b"), "key")
    pairs = rest.join(own.join(accepted, "record_id", "left_semi").select(F.col("record_id").alias("a"), "key"), "key").where("a < b").select("a", "b")
    if old is not None:
        pairs = pairs.unionByName(old)
    out = stored(pairs.distinct().select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b")), "pairs")
    held = keyed.join(accepted, "record_id", "left_semi")
    entries = held.select(F.explode(exact_keys()).alias("key"), "record_id", F.lit(None).cast("string").alias("dkey")).unionByName(held.select(F.explode(window_keys()).alias("key"), "record_id", "dkey"))
    history.entries.add(entries, history.bits)
    history.counts.add(counts, history.bits)
    if len(history.entries.held) >= COMPACT_EVERY:
        history.compact()
    history.save()
    pad.clear()
    tidy(history.spark)
    return out


def batch_number(rows: DataFrame, batches: int) -> DataFrame:
    """import_id, batch: the first import alone, the others in shares of about equal numbers by their first row.

    The bounds are approximate quantiles, one value a batch. They do not change which rows repeat which, but for keys
    that only a later import shows to be shared.
    """
    imports = rows.groupBy("import_id").agg(F.min("record_id").alias("start"))
    at = [k / (batches - 1) for k in range(1, batches - 1)]
    first, bounds = imports.agg(F.min_by("import_id", F.struct("start", "import_id")), F.percentile_approx("start", at) if at else F.array()).first()
    later = F.lit(1)
    for x in bounds or []:
        later = later + (F.col("start") > x).cast("int")
    return imports.select("import_id", F.when(F.col("import_id") == F.lit(first), 0).otherwise(later).alias("batch"))


def replay(rows: DataFrame, batches: int = 4, history: History | None = None) -> DataFrame:
    """Replays a table of imports batch by batch: record_id_a (accepted), record_id_b (its repeat).

    rows(record_id, import_id, company_name, domain, linkedin_url, city, phone). Rows without a usable domain or
    page are accepted and repeat nothing; null names, cities and phones agree with nothing; a record_id given
    twice counts once, its least row; an empty table gives no pairs. Extra columns are not read. Four batches see the
    runs compacted once.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("import_id", F.coalesce("import_id", F.lit("")))
    base = normalised(rows.join(batch_number(rows, batches), "import_id"))
    once = stored(base.groupBy("record_id").agg(F.min(F.struct("batch", *PROFILE, "path")).alias("r")).select("record_id", "r.*"), "normalised")
    history, found = history or History(spark), None
    for b in range(batches):
        pairs = add_batch(history, once.where(F.col("batch") == b))
        found = pairs if found is None else found.unionByName(pairs)
    return found
