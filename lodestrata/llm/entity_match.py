"""Companies of two sources matched without a common key.

Rows of the target table are first gathered into entities by what identifies them (domain, page; name with place
where both are missing). Entities are the documents of an inverted index over all attributes: the words of the name,
the name as a whole, domain, city and country. People's typed employers, collapsed to distinct profiles, are the
queries. A pair's score is BM25: rarity of each shared term, times its saturated frequency among the entity's
statements of that attribute. Typed words that no entity has are first repaired to words of the index.

Retrieval is exact for the TOP best entities of a query, by bounds on the terms:

* rare terms (LIGHT entities at most) are expanded, which gives candidates; frequent terms and places are then only
  looked up for candidates;
* an entity that shares nothing but frequent terms scores at most the sum of their upper bounds. Where that stays
  below the best score by the gap that counts as full, such an entity changes nothing and is pruned unseen;
* the other queries are reduced to their distinct sets of frequent terms and places, which are few, and each set is
  expanded once, over all holders. Nothing is dropped, however many hold a term.

The best entity must be a mutual nearest one: no query that is nearer to some other entity is nearer to it. A logistic
function of the gap to the next entity, the share of the name that fits and the places, calibrated on pairs whose mail
domain tells the truth, gives log odds; what a mail domain adds to them for or against is measured as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.canonical_list import map_values
from lodestrata.operators import keys as K
from lodestrata.session import stored as kept
from lodestrata.session import tidy

TOP = 10
LIGHT = 50
K1 = 0.3  # BM25's saturation; its length normalisation is full (b = 1)
SATURATED = 5.0  # a gap that counts as full
NAME_FLOOR = 0.7  # the share of a typed name's words that must fit, unless the host does
LABELLED = 20_000
ACCEPT = 0.4
NO_GAP = 0.002  # of a full gap: entities so near to each other are alike
# What people add to the name of their employer.
ADDED = r"(?i)\s*(?:\|.*|\((?:part|full)[- ]time\)|\((?:self|freelance|contract)[^)]*\)|\s-\s(?:[A-Z]{2}|[A-Z][a-z]+)$|[®™©]|we'?re hiring.*)\s*$"
NOBODY = r"^(?:confidential|self[- ]?employed|freelanc\w*|independent(?: consultant)?|stealth.*|private|unemployed|retired|n/?a|none|unknown|various|-)$"
LEGAL = "inc|incorporated|llc|ltd|limited|gmbh|ag|sa|s a|bv|b v|nv|plc|corp|corporation|co|and co|company|holdings?|group|srl|sas|sarl|oy|ab|as|kg|pty|pte|llp|lp"
# Words that only connect.
CONNECTING = ("of", "by", "the", "and", "at", "for", "a", "de", "der", "und", "y", "et")
FEATURES = ("name", "city_same", "city_other", "country_same", "country_other", "gap")


def stored(df: DataFrame, what: str) -> DataFrame:
    """A step's result, stored. The many steps plan much and leave shuffle files behind, which are dropped at once."""
    out = kept(df, what)
    tidy(df.sparkSession)
    return out


def words_of(c: Column) -> Column:
    """The words of a company's name: no additions, accents, legal form or article; joined capitals apart."""
    t = F.regexp_replace(F.regexp_replace(c, ADDED, ""), ADDED, "")
    t = F.regexp_replace(F.regexp_replace(t, r"\bGmbH\b", "gmbh"), r"([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(F.lower(t), "&", " and "), r"(?U)[^\w]+", " ")
    t = F.regexp_replace(F.trim(t), r"^the (.*) company$", "$1")
    t = F.trim(F.regexp_replace(F.trim(t), rf"(?: (?:{LEGAL}))+$", ""))
    words = F.split(t, " ")
    telling = F.filter(words, lambda w: ~w.isin(*CONNECTING))
    return F.when(~F.lower(F.trim(c)).rlike(NOBODY) & (t != ""), F.when(F.size(telling) > 0, telling).otherwise(words))


def core_of(host: Column) -> Column:
    """The letters of a host's stem without the usual additions (get..., ...hq)."""
    t = F.regexp_replace(K.stem(host), r"[^a-z0-9]", "")
    return F.regexp_replace(F.regexp_replace(t, r"^(?:get|new|try|use|join|go)(?=.{8})", ""), r"(?<=.{8})(?:hq|online|app|group)$", "")


def countries(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Typed countries mapped to the reference list: country, country_ref (0 for none)."""
    some = reference.where(F.col("kind") == "country")
    got = map_values(df.where("country IS NOT NULL").select(F.lit("country").alias("kind"), F.col("country").alias("value")).distinct(), some)
    return got.select(F.col("value").alias("country"), F.col("ref_id").alias("country_ref"))


def spread_minimum(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Labelling column by column: every row takes the least label among the rows that share the column's value."""
    for c in columns:
        least = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("entity").alias("least"))
        rows = rows.join(least, c, "left").withColumn("entity", F.least("entity", F.coalesce("least", "entity"))).drop("least")
    return rows


def connected(rows: DataFrame) -> DataFrame:
    """d, l, least: the least label among all rows that keys connect with a pair of domain and page (one may be null).

    The passes go over distinct pairs and end only when no page joins two labels: a chain of any length is one entity.
    """
    pairs = rows.where("dkey IS NOT NULL OR lkey IS NOT NULL").groupBy("dkey", "lkey").agg(F.min("entity").alias("entity"))
    while True:
        # The last pass leaves one label a domain; where every page has one too, nothing is left to spread.
        pairs = stored(spread_minimum(pairs, ["dkey", "lkey", "dkey"]), "links")
        if not pairs.where("lkey IS NOT NULL").groupBy("lkey").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where("a < b").take(1):
            return pairs.select(F.col("dkey").alias("d"), F.col("lkey").alias("l"), F.col("entity").alias("least"))


def prepared_targets(df: DataFrame) -> DataFrame:
    """row_id, dkey, lkey, words, city, country of the target rows."""
    d = F.coalesce(K.host(F.col("domain")), K.host(F.when(~F.col("website").contains("@"), F.col("website"))))
    return df.where("row_id IS NOT NULL").select(
        "row_id", d.alias("dkey"), K.page(F.col("linkedin_url")).alias("lkey"), words_of(F.regexp_replace("company_name", r"(?U)\s+", " ")).alias("words"), K.place_key(F.col("city")).alias("city"), "country"
    )


def entities(rows: DataFrame) -> DataFrame:
    """The target rows with an entity label: rows that domains and pages connect, over any number of steps.

    Keys that stand by many unrelated names identify nobody. Where both keys are missing the name and the city stand
    in, unless several entities answer to them.
    """
    rows = rows.withColumn("name", F.array_join("words", "")).withColumn("entity", F.col("row_id"))
    each = rows.select("name", F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.col("dkey").alias("key")), F.struct(F.lit("l").alias("kind"), F.col("lkey").alias("key")))).alias("k"))
    named = each.where(F.col("k.key").isNotNull() & F.col("name").isNotNull()).groupBy("k.kind", "k.key", "name").agg(F.count("*").alias("n"))
    shared = named.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count("*").alias("names")).where("names >= 4 AND 2 * names >= n").select("kind", "key", F.lit(True).alias("gone"))
    for kind, c in (("d", "dkey"), ("l", "lkey")):
        some = shared.where(F.col("kind") == kind).select(F.col("key").alias(c), "gone")
        rows = rows.join(some, c, "left").withColumn(c, F.when(F.col("gone").isNull(), F.col(c))).drop("gone")
    place = F.when(F.col("name").isNotNull() & F.col("city").isNotNull(), F.concat_ws("|", "name", "city"))
    rows = rows.withColumn("place", place).join(connected(rows), [F.col("dkey").eqNullSafe(F.col("d")), F.col("lkey").eqNullSafe(F.col("l"))], "left")
    rows = stored(rows.withColumn("entity", F.coalesce("least", "entity")).drop("d", "l", "least"), "targets")
    alone = F.col("dkey").isNull() & F.col("lkey").isNull()
    by_place = rows.where("place IS NOT NULL").groupBy("place").agg(
        F.min(F.when(~alone, F.col("entity"))).alias("only"), F.max(F.when(~alone, F.col("entity"))).alias("last"), F.min(F.when(alone, F.col("entity"))).alias("first")
    )
    rows = rows.join(by_place, "place", "left")
    stand_in = F.coalesce(F.when(F.col("only") == F.col("last"), F.col("only")), F.col("first"), F.col("entity"))
    return rows.withColumn("entity", F.when(alone, stand_in).otherwise(F.col("entity"))).drop("only", "last", "first", "place", "name")

Terms = list[tuple[str, str, Column]]  # slot, kind of token, value


def exploded(df: DataFrame, keep: str, terms: Terms) -> DataFrame:
    """keep, slot, token: the words of a name (slots w0, w1, ...) and the given terms. Terms of one slot say one thing."""
    none = F.array().cast("array<struct<slot:string,token:string>>")
    words = F.transform("words", lambda w, i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("slot"), F.concat(F.lit("w:"), w).alias("token")))
    others = [F.when(c.isNotNull(), F.struct(F.lit(slot).alias("slot"), F.concat(F.lit(kind), c.cast("string")).alias("token"))) for slot, kind, c in terms]
    return df.select(keep, F.explode(F.concat(F.coalesce(words, none), F.array_compact(F.array(*others)))).alias("s")).select(keep, "s.slot", "s.token")


def whole() -> Column:
    """A name run together; null for none."""
    c = F.array_join("words", "")
    return F.when(c != "", c)


def any_order() -> Column:
    """A name run together with its words in alphabetical order; null for less than two."""
    return F.when(F.size("words") > 1, F.array_join(F.array_sort("words"), ""))


def rarity(df: Column, n: int) -> Column:
    """BM25's weight of a term that df of n entities hold."""
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def inverted_index(t: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(entity, term, sat of every entity; token, df; the number of entities). A term is the hash of a token.

    t: target rows with entity, words, dkey, city, country_ref. A term's frequency is the number of rows that state
    it; the length of its field is the number of rows that state the field, and the normalisation by it is full. The
    tokens ?d, ?c and ?k say that an entity has a domain, a city, a country at all.
    """
    said = exploded(t, "entity", [("n", "n:", whole()), ("s", "s:", any_order()), ("d", "d:", F.col("dkey")), ("o", "o:", core_of(F.col("dkey"))), ("c", "c:", F.col("city")), ("k", "k:", F.col("country_ref"))])
    tf = said.groupBy("entity", F.substring("slot", 1, 1).alias("field"), "token").agg(F.count("*").alias("tf"))
    length = tf.groupBy("entity", "field").agg(F.when(F.col("field") == "w", F.max("tf")).otherwise(F.sum("tf")).alias("dl"))
    size = length.groupBy("field").agg(F.avg("dl").alias("avgdl"))  # six rows
    tfn = F.col("tf") * F.col("avgdl") / F.col("dl")
    share = tf.join(length, ["entity", "field"]).join(F.broadcast(size), "field").select("entity", "token", (tfn * (1 + K1) / (tfn + K1)).alias("sat"))
    known = length.where("field IN ('d', 'c', 'k')").select("entity", F.concat(F.lit("?"), "field").alias("token"), F.lit(0.0).alias("sat"))
    index = stored(share.unionByName(known).withColumn("term", F.xxhash64("token")), "index")
    df = stored(index.groupBy("token").agg(F.count("*").alias("df")), "rarity")
    return index.drop("token"), df, t.agg(F.count_distinct("entity")).first()[0]


def repairs(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, itoken, sim: terms that no entity has, and those of the index that are two edits away or begin so.

    Both sides are distinct words and names. They meet by what is left without one letter, or by the beginning.
    """
    bare = lambda c: F.substr(F.col(c), F.lit(3))
    keyed = lambda mark, c, xs: F.transform(xs, lambda v: F.concat(F.lit(mark), F.substring(c, 1, 2), v))
    none = F.array().cast("array<string>")
    word = F.col("token").startswith("w:")
    size = F.length("token") - 2
    deleted = F.coalesce(F.when(size >= 6, keyed("x", "token", K.one_deletions(bare("token")))), none)
    begun = F.when(word & (size >= 4), F.array(F.concat(F.lit("p"), "token")))
    begins = F.when(word & (size > 4), keyed("p", "token", F.transform(F.sequence(F.lit(4), size - 1), lambda i: F.substring("token", F.lit(3), i))))
    hashed = lambda c: c.select("*", F.xxhash64("key").alias("h"), F.col("key").startswith("p").alias("by_start")).drop("key")
    a = hashed(unknown.select("token", F.explode(F.concat(deleted, F.coalesce(begun, none))).alias("key"))).drop("by_start")
    b = hashed(vocabulary.select(F.col("token").alias("itoken"), F.explode(F.concat(deleted, F.coalesce(begins, none))).alias("key")))
    d = F.levenshtein("token", "itoken")
    long = F.greatest(F.length("token"), F.length("itoken")) - 2
    sim = F.when((d <= 2) & (long >= 7), 1 - d / long).when(F.col("by_start") & F.startswith("itoken", "token"), (F.length("token") - 2) / long)
    return a.join(b, "h").select("token", "itoken", sim.alias("sim")).where("sim IS NOT NULL").groupBy("token", "itoken").agg(F.max("sim").alias("sim"))


def asked_terms(queries: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """query, slot, term (of the index; null where it has none alike), df, gain (what a full fit brings), sim."""
    asks: Terms = [("n", "n:", whole()), ("n", "s:", any_order()), ("n", "o:", whole()), ("n", "n:", F.col("typed_core")), ("n", "o:", F.col("typed_core")), ("f", "n:", F.col("mail_core")), ("o", "o:", F.col("mail_core"))]
    asks += [("d", "d:", F.col("mail")), ("d", "d:", F.col("typed_host")), ("c", "c:", F.col("city")), ("k", "k:", F.col("country_ref"))]
    asks += [(f"?{x}", "?", F.when(F.col(c).isNotNull(), F.lit(x))) for x, c in (("d", "mail"), ("c", "city"), ("k", "country_ref"))]
    wanted = exploded(queries, "query", asks).distinct()
    found = wanted.join(df, "token", "left")
    unknown = found.where("df IS NULL AND (slot = 'n' OR slot LIKE 'w%')").select("token").distinct()
    alike = repairs(unknown, df.where("token LIKE 'w:%' OR token LIKE 'n:%'")).join(df.withColumnRenamed("token", "itoken"), "itoken")
    known = found.where("df IS NOT NULL").select("query", "slot", F.xxhash64("token").alias("term"), "df", F.lit(1.0).alias("sim"))
    mended = found.where("df IS NULL").drop("df").join(alike, "token", "left").select("query", "slot", F.when(F.col("itoken").isNotNull(), F.xxhash64("itoken")).alias("term"), F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("sim", F.lit(1.0)).alias("sim"))
    both = known.unionByName(mended)
    # A mail host that spells the name says less than the name itself.
    part = F.when(F.col("slot").startswith("?"), 0.0).when(F.col("slot").isin("f", "o"), 0.5).otherwise(1.0)
    return both.withColumn("gain", part * F.col("sim") * rarity(F.col("df"), n))


def brought(asked: DataFrame, index: DataFrame) -> DataFrame:
    """The slots of a pair of query and entity that a term joins: what each brings and how well it fits."""
    return asked.join(index, "term").select("query", "entity", "slot", (F.col("gain") * F.col("sat")).alias("got"), "sim")


def of_slots(rows: DataFrame) -> DataFrame:
    """One row a pair of query and entity: its score and what the slots say. rows: see brought."""
    best = rows.groupBy("query", "entity", "slot").agg(F.max("got").alias("got"), F.max("sim").alias("sim"))
    slot, is_word = F.col("slot"), F.col("slot").startswith("w")
    has = lambda x: F.max(slot == x)
    return best.groupBy("query", "entity").agg(
        F.round(F.sum("got"), 6).alias("score"), F.round(F.sum(F.when(slot == "d", F.col("got")).otherwise(0.0)), 6).alias("host"), F.sum(F.when(is_word, F.col("sim")).otherwise(0.0)).alias("words_fit"),
        F.coalesce(F.max(F.when(slot == "n", F.col("sim"))), F.lit(0.0)).alias("whole_fit"), has("d").alias("mail_same"), has("f").alias("fits"), has("c").alias("city_same"), has("k").alias("country_same"),
        has("?d").alias("has_domain"), has("?c").alias("has_city"), has("?k").alias("has_country"),
    )


def name_fit() -> Column:
    """The share of a typed name that an entity fits: its words, or the name as a whole."""
    return F.greatest("whole_fit", F.try_divide("words_fit", "n_words"), F.lit(0.0))


def acceptable() -> Column:
    """Whether an entity has a query's host or enough of its name."""
    return F.col("mail_same") | (name_fit() >= NAME_FLOOR)


def top_pairs(queries: DataFrame, index: DataFrame, df: DataFrame, n: int, light: int = LIGHT) -> DataFrame:
    """The TOP best entities of every query with their features (of_slots), exactly; see the head of the module.

    Entities that fall behind the best by more than a full gap, even where its host does not count, are left out; so are
    queries whose best entity has neither the host nor enough of the name.
    Entities that share no name, name-like host or host with a query are no candidates, whatever place they share.
    """
    asked = stored(asked_terms(queries, df, n).repartition("query"), "asked")
    most = 1 + K1
    telling = F.col("slot").startswith("w") | F.col("slot").isin("n", "f", "o", "d")
    rare = F.col("df") <= light
    # What frequent terms can bring at most, and what of the name they can fit.
    per_slot = asked.groupBy("query", "slot").agg(
        F.max("gain").alias("gain"), F.coalesce(F.max(F.when(~rare & F.col("term").isNotNull(), F.col("gain"))), F.lit(0.0)).alias("common"), F.max(telling & ~rare & F.col("term").isNotNull()).alias("open")
    )
    bounds = per_slot.groupBy("query").agg(
        (F.sum("gain") * most).alias("self"), (SATURATED + most * F.sum(F.when(F.col("slot") == "d", F.col("gain")).otherwise(0.0))).alias("margin"), (F.sum(F.when(telling, F.col("common")).when(F.col("slot").isin("c", "k"), F.col("gain")).otherwise(0.0)) * most).alias("rest"), F.max("open").alias("open"),
        F.coalesce(F.max(F.col("open") & F.col("slot").isin("n", "f", "o", "d")), F.lit(False)).alias("alone"), F.sum(F.when(F.col("open") & F.col("slot").startswith("w"), 1.0).otherwise(0.0)).alias("common_words"), F.sum(F.when(F.col("slot").startswith("w"), 1.0).otherwise(0.0)).alias("n_words"),
    )
    found = stored(brought(asked.where(telling & rare), index), "found").repartition("query")
    sums = found.groupBy("query", "entity", "slot").agg(F.max("got").alias("got")).groupBy("query", "entity").agg(F.round(F.sum("got"), 6).alias("light"))
    # A candidate that even all frequent terms cannot bring within a full gap of the best one, whether the host counts
    # or not, changes nothing.
    lead = sums.groupBy("query").agg(F.max("light").alias("lead"))
    near = sums.join(lead, "query").join(bounds.select("query", "rest", "margin"), "query").where(F.col("light") + F.col("rest") > F.col("lead") - F.col("margin")).select("query", "entity")
    near = stored(near, "near")
    looked_up = near.join(asked.where("term IS NOT NULL").where(~(telling & rare)), "query").join(index, ["entity", "term"]).select("query", "entity", "slot", (F.col("gain") * F.col("sat")).alias("got"), "sim")
    direct = stored(of_slots(found.join(near, ["query", "entity"], "left_semi").unionByName(looked_up).repartition("query")), "candidates")
    # Queries that an entity with nothing but frequent terms could still matter to: it may be acceptable by itself, or
    # be too near to an acceptable best one.
    ahead = direct.join(bounds.select("query", "n_words"), "query").groupBy("query").agg(F.max_by(F.struct((F.col("score") - F.col("host")).alias("base"), acceptable().alias("fit")), F.struct("score", -F.col("entity"))).alias("ahead"))
    able = F.col("alone") | (F.col("common_words") >= NAME_FLOOR * F.col("n_words"))
    waiting = bounds.where("open").join(ahead, "query", "left").where(able | F.coalesce(F.col("ahead.fit") & (F.col("rest") > F.col("ahead.base") - SATURATED), F.lit(False))).select("query")
    common = asked.where("term IS NOT NULL").where(~(telling & rare)).join(waiting, "query", "left_semi")
    sets = common.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("slot", "term", "sim", "gain"))).alias("terms")).select("query", "terms", F.md5(F.to_json("terms")).alias("set"))
    sets = stored(sets, "sets")
    each = sets.groupBy("set").agg(F.first("terms").alias("terms")).select(F.col("set").alias("query"), F.explode("terms").alias("t")).select("query", "t.*")
    held = stored(brought(each.where(telling), index), "holders")
    holders = held.select("query", "entity").distinct()
    places = holders.join(each.where(~telling), "query").join(index, ["entity", "term"]).select("query", "entity", "slot", (F.col("gain") * F.col("sat")).alias("got"), "sim")
    shared = of_slots(held.unionByName(places))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "entity")
    shared = shared.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= TOP).drop("rank").withColumnRenamed("query", "set")
    more = sets.select("query", "set").join(stored(shared, "shared"), "set").drop("set")
    # An entity met both ways keeps its full score.
    both = direct.unionByName(more.join(direct.select("query", "entity"), ["query", "entity"], "left_anti").select(direct.columns))
    ranked = both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= TOP)
    ranked = ranked.join(bounds.select("query", "self", "n_words"), "query")
    first = F.max(F.when(F.col("rank") == 1, F.struct((F.col("score") - F.col("host")).alias("base"), acceptable().alias("fit")))).over(Window.partitionBy("query"))
    return ranked.withColumn("ahead", first).where(F.col("ahead.fit") & (F.col("score") > F.col("ahead.base") - SATURATED)).drop("ahead")


def judged(top: DataFrame, queries: DataFrame) -> DataFrame:
    """The pairs of top_pairs with FEATURES, has_mail and mutual.

    gap: a pair's score without its host, less the best of the query's other entities. mutual: the entity is the
    query's nearest, and no query with another nearest entity is nearer to it, by the share of a query's full score.
    """
    base = F.col("score") - F.col("host")
    per = top.groupBy("query").agg(F.array_sort(F.collect_list(-base)).alias("bases"))  # TOP at most
    p = top.join(per, "query").join(queries.select("query", F.col("mail").isNotNull().alias("has_mail"), F.col("city").isNotNull().alias("asks_city"), F.col("country_ref").isNotNull().alias("asks_country")), "query")
    first, second = -F.col("bases")[0], F.coalesce(-F.try_element_at("bases", F.lit(2)), F.lit(0.0))
    gap = base - F.when(base >= first, second).otherwise(first)
    near = F.round(F.col("score") / F.col("self"), 6)
    flag = lambda c: c.cast("double")
    p = p.select(
        "query", "entity", "rank", "has_mail", "has_domain", "mail_same", "fits", "host", near.alias("near"), name_fit().alias("name"), flag(F.col("city_same")).alias("city_same"),
        flag(F.col("asks_city") & F.col("has_city") & ~F.col("city_same")).alias("city_other"), flag(F.col("country_same")).alias("country_same"), flag(F.col("asks_country") & F.col("has_country") & ~F.col("country_same")).alias("country_other"),
        (F.least(F.greatest(gap, F.lit(-SATURATED)), F.lit(SATURATED)) / SATURATED).alias("gap"),
    )
    p = stored(p, "judged")
    rivals = p.where("rank > 1").groupBy("entity").agg(F.max("near").alias("rival"))
    return p.join(rivals, "entity", "left").withColumn("mutual", (F.col("rank") == 1) & (F.col("near") >= F.coalesce("rival", F.lit(0.0)))).drop("rival", "near")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 2_000, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * w)
    return w


@dataclass(frozen=True)
class Calibration:
    """Log odds of a pair: weights of FEATURES and a constant, and what the mail adds to them.

    unlike: where it differs from a known domain. fitting, unfitting: where no domain is known and it spells the
    name, or does not. An equal domain adds its rarity.
    """

    weights: tuple[float, ...] = (4.0, 2.5, -1.5, 0.9, -0.9, 3.0, -5.5)
    unlike: float = -5.0
    fitting: float = 2.0
    unfitting: float = -3.0


def calibrate(pairs: DataFrame) -> Calibration:
    """Fitted on pairs with a mail and a known domain: equal is a match, else none. The standard one below 50 pairs.

    At most LABELLED pairs are used, those with the least hash of their ids, so the same at every run.
    """
    some = pairs.where("has_mail AND has_domain").select(F.col("mail_same").cast("double").alias("y"), *FEATURES, F.col("fits").cast("double"), F.xxhash64("query", "entity").alias("h")).orderBy("h").limit(LABELLED)
    rows = np.array(some.select("y", *FEATURES, "fits").collect(), float).reshape(-1, len(FEATURES) + 2)
    y, x, fits = rows[:, 0], rows[:, 1:-1], rows[:, -1]
    if len(rows) < 50 or y.sum() < 25 or (1 - y).sum() < 25:
        return Calibration()
    w = fit(x, y)
    # Agreement never speaks against a match, nor disagreement for it.
    sign = np.array([1, 1, -1, 1, -1, 1])
    w[:-1] = np.where(w[:-1] * sign > 0, w[:-1], 0.0)
    # How often a match has another domain is measured where all else agrees: elsewhere namesakes would count as matches.
    f = dict(zip(FEATURES, x.T))
    sure = (f["name"] >= 1) & (f["city_same"] > 0) & (f["country_other"] == 0) & (f["gap"] >= 1)
    share = lambda hits, of: (float(hits.sum()) + 1) / (float(of.sum()) + 2)
    same = share(sure & (y > 0), sure)
    unlike = math.log(1 - same) if sure.sum() >= 50 else Calibration.unlike
    named = x[:, 0] >= NAME_FLOOR
    a, b = share(named & (y > 0) & (fits > 0), named & (y > 0)), share(named & (y == 0) & (fits > 0), named & (y == 0))
    return Calibration(tuple(map(float, w)), unlike, max(0.0, math.log(a / b)), min(0.0, math.log((1 - a) / (1 - b))))


def confidence(c: Calibration) -> Column:
    """The logistic function of a pair's log odds."""
    z = F.lit(c.weights[-1])
    for f, x in zip(FEATURES, c.weights):
        z = z + F.col(f) * x
    mail = F.when(F.col("mail_same"), F.col("host")).when(F.col("has_mail") & F.col("has_domain"), F.lit(c.unlike)).when(F.col("has_mail"), F.when(F.col("fits"), F.lit(c.fitting)).otherwise(F.lit(c.unfitting))).otherwise(0.0)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(z + mail))), 4)


@dataclass(frozen=True)
class Matches:
    """queries: (query, entity, confidence) of accepted matches, one entity a query at most. people: (salesnav_row_id,
    query); targets: (aiark_row_id, entity): which rows they stand for."""

    queries: DataFrame
    people: DataFrame
    targets: DataFrame


def typed_profiles(people: DataFrame, places: DataFrame) -> DataFrame:
    """row_id, query and what the query is made of: mail host, words, typed host, city, country_ref."""
    mail = F.lower(F.regexp_extract(K.blank_to_null(F.col("email")), r"@([^@\s>]+)\s*>?$", 1))
    q = people.where("row_id IS NOT NULL").select(
        "row_id", K.host(mail).alias("mail"), words_of(F.col("company")).alias("words"), K.host(F.when(F.col("company").rlike(r"^\S+\.\S+$"), F.col("company"))).alias("typed_host"), K.place_key(F.col("city")).alias("city"), "country"
    ).join(places, "country", "left").drop("country")
    # Hosts of private mail: many employers, hardly any of which shows in the host.
    shows = F.coalesce(F.exists("words", lambda w: (F.length(w) >= 4) & F.contains(F.col("mail"), F.substring(w, 1, 4))), F.lit(False))
    names = q.where("mail IS NOT NULL AND words IS NOT NULL").groupBy("mail", "words").agg(F.count("*").alias("n"), F.sum(shows.cast("int")).alias("shown"))
    private = names.groupBy("mail").agg(F.count("*").alias("names"), (F.sum("shown") / F.sum("n")).alias("share")).where("names >= 3 AND share < 0.25").select("mail", F.lit(True).alias("private"))
    q = q.join(private, "mail", "left").withColumn("mail", F.when(F.col("private").isNull(), F.col("mail"))).drop("private")
    return q.withColumn("query", F.xxhash64(F.to_json(F.struct("mail", "words", "typed_host", "city", "country_ref"))))


def match(targets: DataFrame, people: DataFrame, reference: DataFrame, light: int = LIGHT) -> Matches:
    """The companies of targets that people's typed employers mean.

    Rows without a name, domain and mail match nothing; null places neither agree nor disagree; of several entities
    alike in everything (no gap) none is chosen; repeated rows stand for one query. Empty tables give no matches.
    """
    tidy(targets.sparkSession)
    raw = stored(prepared_targets(targets), "targets")
    places = countries(raw.select("country").unionByName(people.select("country")), reference).where("country_ref > 0")
    places = stored(places, "countries")  # distinct spellings
    t = stored(entities(raw).join(places, "country", "left").drop("country", "lkey"), "entities")
    q = stored(typed_profiles(people, places), "people")
    queries = q.groupBy("query").agg(*[F.first(c).alias(c) for c in ("mail", "words", "typed_host", "city", "country_ref")]).withColumns({"mail_core": core_of(F.col("mail")), "typed_core": core_of(F.col("typed_host"))})
    index, df, n = inverted_index(t)
    pairs = stored(judged(top_pairs(queries, index, df, n, light), queries), "pairs")
    scored = pairs.withColumn("confidence", confidence(calibrate(pairs)))
    fits = F.col("mail_same") | ((F.col("name") >= NAME_FLOOR) & (F.col("gap") > NO_GAP))
    good = scored.where(F.col("mutual") & fits & (F.col("confidence") >= ACCEPT)).select("query", "entity", "confidence")
    return Matches(good, q.select(F.col("row_id").alias("salesnav_row_id"), "query"), t.select(F.col("row_id").alias("aiark_row_id"), "entity"))


def matched_pairs(m: Matches) -> DataFrame:
    """aiark_row_id, salesnav_row_id, confidence of every pair of rows that concern the same company."""
    out = m.queries.join(m.people, "query").join(m.targets, "entity")
    return out.groupBy("aiark_row_id", "salesnav_row_id").agg(F.max("confidence").alias("confidence"))


def matched_people(m: Matches) -> DataFrame:
    """salesnav_row_id, entity (the least row of the company in the other table), confidence; one row a matched row."""
    return m.people.join(m.queries, "query").groupBy("salesnav_row_id").agg(F.max(F.struct("confidence", "entity")).alias("m")).select("salesnav_row_id", "m.entity", "m.confidence")
