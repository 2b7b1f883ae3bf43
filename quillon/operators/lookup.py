"""Looking cards up by name and by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.columns import clean_id
from quillon.functions.text import collate, collate_text, trigram_similarity
from quillon.operators.search import prefer_keys
from quillon.runtime import materialise

#: Least similarity of a fuzzy hit, and the lead it must have over the next card of another name.
FUZZY_FLOOR, FUZZY_LEAD = 0.625, 0.002
AUTOCOMPLETE = 20


def _tier(name: Column) -> Column:
    """How a collated name hits a row: its whole name before a face's name before another printed name."""
    return (
        F.when(F.col("name_collated") == name, 2)
        .when(F.array_contains(F.coalesce("face_names_collated", F.array().cast("array<string>")), name), 1)
        .when((F.col("flavor_collated") == name) | (F.col("printed_collated") == name), 0)
    )


def exact(prepared: DataFrame, name: str, set_code: str | None = None) -> DataFrame:
    """The one row whose name is this, without regard to accents, case and punctuation; none if no name is."""
    hits = prepared.withColumn("tier", _tier(F.lit(collate_text(name)))).where("tier is not null")
    if set_code:
        hits = hits.where(F.col("set_code") == set_code.lower())
    return hits.orderBy(F.col("tier").desc(), *prefer_keys("default")).limit(1)


def exact_many(prepared: DataFrame, names: DataFrame) -> DataFrame:
    """For every row of ``names`` (name) the row that ``exact`` would give: an equi-join, whatever the number of names."""
    asked = names.select("name").distinct().withColumn("key", collate(F.col("name"))).where("key <> ''")
    keys = F.array_compact(F.array(
        F.struct(F.lit(2).alias("tier"), F.col("name_collated").alias("key")),
        F.struct(F.lit(0).alias("tier"), F.col("flavor_collated").alias("key")),
        F.struct(F.lit(0).alias("tier"), F.col("printed_collated").alias("key")),
    ))
    faces = F.transform(F.coalesce("face_names_collated", F.array().cast("array<string>")), lambda k: F.struct(F.lit(1).alias("tier"), k.alias("key")))
    # one row a key before the names are joined, from the few columns that decide; the others are fetched for the hits
    keyed = prepared.select("scryfall_id", *PREFERRED, F.explode(F.concat(keys, faces)).alias("k")).select("*", "k.key", "k.tier").drop("k").where("key <> ''")
    best = Window.partitionBy("key").orderBy(F.col("tier").desc(), *prefer_keys("default"))
    hits = keyed.withColumn("_best", F.row_number().over(best)).where("_best = 1").select("key", "scryfall_id", "tier")
    return asked.join(hits, "key").select("name", "tier", "scryfall_id").join(prepared, "scryfall_id")


def _one_per_name(prepared: DataFrame) -> DataFrame:
    best = Window.partitionBy("name_collated").orderBy(*prefer_keys("default"))
    return prepared.where("is_canonical and name_collated <> ''").withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")


def fuzzy(prepared: DataFrame, name: str) -> DataFrame:
    """The row of the name most like this one, with ``similarity`` and ``ambiguous``; none below the floor.

    Similarity is the Jaccard index of trigrams of collated names.  A hit is ambiguous if another card of another name
    comes within the lead.
    """
    like = _one_per_name(prepared).withColumn("similarity", trigram_similarity(F.col("name_collated"), F.lit(collate_text(name)))).where(F.col("similarity") >= FUZZY_FLOOR)
    best = like.orderBy(F.col("similarity").desc(), "name_collated").limit(1)
    # two numbers and a key decide, so they are asked for first
    found = best.select("card_key", "similarity").first()
    rival = like.where(F.col("card_key") != found["card_key"]).agg(F.max("similarity")).first()[0] if found else None
    close = rival is not None and found["similarity"] - rival < FUZZY_LEAD
    return best.withColumn("ambiguous", F.lit(close))


def containing(prepared: DataFrame, words: str) -> DataFrame:
    """One row per name that contains every word; if one of them is the whole text, only that."""
    needles = [w for w in map(collate_text, words.split()) if w]
    hits = _one_per_name(prepared)
    for w in needles:
        hits = hits.where(F.contains("name_collated", F.lit(w)))
    if not needles:
        return hits.limit(0)
    whole = F.col("name_collated") == collate_text(words)
    # one bit decides, so it is asked for first
    return hits.where(whole) if prepared.where(F.col("is_canonical") & whole).limit(1).count() else hits


def autocomplete(prepared: DataFrame, start: str) -> DataFrame:
    """Up to twenty names for a beginning of two or more characters: those that begin so, then the most similar."""
    needle = collate_text(start)
    names = prepared.where("is_canonical and not array_contains(is_tags, 'extra')").groupBy("name_collated").agg(F.min("card_name").alias("card_name"))
    if len(needle) < 2:
        return names.select("card_name", F.lit(0).alias("position")).limit(0)
    hits = names.where(F.contains("name_collated", F.lit(needle)))
    hits = hits.withColumn("starts", F.startswith("name_collated", F.lit(needle))).withColumn("similarity", F.round(trigram_similarity(F.col("name_collated"), F.lit(needle)), 9))
    keys = [F.col("starts").desc(), F.col("similarity").desc(), F.col("name_collated").asc()]
    top = hits.orderBy(*keys).limit(AUTOCOMPLETE)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1).select("card_name", "position")


#: What ``prefer_keys("default")`` reads beside the id.
PREFERRED = ("is_canonical", "prefer_score")
#: How a collection names a card: its kind, what ``asked`` must hold, and the value that a prepared row is found by.
IDENTIFIERS = ("id", "oracle_id", "illustration_id", "mtgo_id", "multiverse_id", "set_number", "name_set", "name")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *(p.cast("string") for p in parts))


def collection(prepared: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cards that a list of identifiers names, and the identifiers that name none, both with the list's ``position``.

    ``asked`` has ``position`` and any of ``id, oracle_id, illustration_id, mtgo_id, multiverse_id, name, set,
    collector_number``; a row is read by the first of these that it has: id, card, artwork, ids of other catalogues, set
    with number, name with or without set.  Repeated identifiers give their card each time.

    Every row of either side becomes a text that names what it is asked by, so that one join serves all kinds; it moves
    keys alone, and rows are fetched for the hits.
    """
    names = ("id", "oracle_id", "illustration_id", "mtgo_id", "multiverse_id", "name", "set", "collector_number")
    asked = asked.select("position", *((F.col(c) if c in asked.columns else F.lit(None)).cast("string").alias(c) for c in names))
    clean = asked.withColumns({"_id": clean_id("id"), "_oracle": clean_id("oracle_id"), "_art": clean_id("illustration_id"), "_name": collate(F.col("name")), "_set": F.lower(F.btrim("set"))})
    c = F.col
    key = (
        F.when(c("_id").isNotNull(), _key("id", c("_id"))).when(c("_oracle").isNotNull(), _key("oracle_id", c("_oracle"))).when(c("_art").isNotNull(), _key("illustration_id", c("_art")))
        .when(c("mtgo_id").isNotNull(), _key("mtgo_id", c("mtgo_id").try_cast("bigint"))).when(c("multiverse_id").isNotNull(), _key("multiverse_id", c("multiverse_id").try_cast("bigint")))
        .when(c("_set").isNotNull() & c("collector_number").isNotNull(), _key("set_number", c("_set"), c("collector_number")))
        .when(c("_set").isNotNull() & (c("_name") != ""), _key("name_set", c("_name"), c("_set"))).when(c("_name") != "", _key("name", c("_name")))
    )
    wanted, _ = materialise(clean.select("position", *names, key.alias("key")), "asked")
    kinds = {r[0] for r in wanted.select(F.substring_index("key", "\x1f", 1)).distinct().collect()} & set(IDENTIFIERS)
    none = F.array().cast("array<string>")
    others = lambda name, kind, value: F.when(c(name).isNotNull(), value).otherwise(none) if name in prepared.columns and kind in kinds else none
    some = {
        "id": _key("id", c("scryfall_id")), "oracle_id": F.when(c("oracle_id").isNotNull(), _key("oracle_id", c("oracle_id"))), "illustration_id": F.when(c("illustration_id").isNotNull(), _key("illustration_id", c("illustration_id"))),
        "set_number": F.when(c("set_code").isNotNull() & c("collector_number").isNotNull(), _key("set_number", c("set_code"), c("collector_number"))),
        "name_set": F.when(c("set_code").isNotNull() & (c("name_collated") != ""), _key("name_set", c("name_collated"), c("set_code"))), "name": F.when(c("name_collated") != "", _key("name", c("name_collated"))),
    }
    single = F.array_compact(F.array(F.lit(None).cast("string"), *(v for k, v in some.items() if k in kinds)))
    mtgo = others("external_ids", "mtgo_id", F.array_compact(F.array(F.when(F.try_element_at("external_ids", F.lit("mtgo_id")).isNotNull(), _key("mtgo_id", F.try_element_at("external_ids", F.lit("mtgo_id")))))))
    verse = others("multiverse_ids", "multiverse_id", F.transform("multiverse_ids", lambda x: _key("multiverse_id", x)))
    keyed = prepared.select("scryfall_id", *PREFERRED, F.explode(F.array_distinct(F.concat(single, mtgo, verse))).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    best = Window.partitionBy("key").orderBy(*prefer_keys("default"))
    hits = keyed.withColumn("_best", F.row_number().over(best)).where("_best = 1").select("key", "scryfall_id")
    matched = wanted.join(hits, "key", "left")
    found = matched.where("scryfall_id is not null").select("position", "scryfall_id").join(prepared, "scryfall_id")
    return found, matched.where("scryfall_id is null").select("position", *names)


def by_id(prepared: DataFrame, scryfall_id: str) -> DataFrame:
    """The printing of this id; a filter that reaches the scan."""
    return prepared.where(F.col("scryfall_id") == scryfall_id.strip().lower())


def by_number(prepared: DataFrame, set_code: str, number: str, lang: str = "en") -> DataFrame:
    """The printing of a set's number in a language."""
    return prepared.where((F.col("set_code") == set_code.lower()) & (F.col("collector_number") == number) & (F.col("lang") == lang)).orderBy(*prefer_keys("default")).limit(1)


def rulings_of(rulings: DataFrame, oracle_id: str) -> DataFrame:
    """A card's rulings, newest first, equal dates by comment."""
    return rulings.where(F.col("oracle_id") == oracle_id.strip().lower()).orderBy(F.col("published_at").desc(), F.col("comment").asc())


def by_external_id(prepared: DataFrame, namespace: str, number: int) -> DataFrame:
    """The preferred printing with an id of another catalogue (``multiverse``, or a key of ``external_ids``)."""
    hit = F.array_contains("multiverse_ids", F.lit(number)) if namespace == "multiverse" else F.try_element_at("external_ids", F.lit(namespace)) == number
    return prepared.where(hit).orderBy(*prefer_keys("default")).limit(1)


def set_of(sets: DataFrame, key: str) -> DataFrame:
    """The set with this code, id, or number of another catalogue, in this order; of several the first in the order of
    ``place`` where the table has one, else of the least id."""
    word = key.strip().lower()
    number = str(int(word)) if word.isascii() and word.isdigit() else word
    rank = F.when(F.lower("code") == word, 0).when(clean_id("id") == word, 1).when(F.col("tcgplayer_id").cast("string") == number, 2)
    return sets.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", *(["place"] if "place" in sets.columns else []), "id").limit(1).drop("_rank")


def first_of_each(prepared: DataFrame, queries: list[str]) -> DataFrame:
    """The most played printing that each query finds, with the query's place in the list as ``query_no``; one pass."""
    from quillon.operators.search import order_keys
    from quillon.plans.compile import condition
    from quillon.plans.query import parse
    from quillon.plans.rewrite import rewrite

    hits = F.array_compact(F.array(*(F.when(condition(rewrite(parse(q)).tree), F.lit(i)) for i, q in enumerate(queries))))
    matched = prepared.where("is_canonical").withColumn("query_no", F.explode(hits))
    first = Window.partitionBy("query_no").orderBy(*order_keys("edhrec"))
    return matched.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")


def routing_keys(rows: DataFrame) -> DataFrame:
    """(key, oracle_id): every id by which a row can be asked for, with the card whose partition holds it."""
    known = rows.withColumn("keys", F.array_compact(F.array("scryfall_id", "illustration_id")))
    if "multiverse_ids" in rows.columns:
        known = known.withColumn("keys", F.concat("keys", F.coalesce(F.transform("multiverse_ids", lambda x: F.concat(F.lit("multiverse:"), x.cast("string"))), F.array().cast("array<string>"))))
    if "external_ids" in rows.columns:
        others = F.transform(F.map_entries("external_ids"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
        known = known.withColumn("keys", F.concat("keys", F.coalesce(others, F.array().cast("array<string>"))))
    return known.select(F.explode("keys").alias("key"), "oracle_id").distinct()
