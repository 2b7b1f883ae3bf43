"""Search: filter, one row per card or artwork, order, page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import slug_text
from quillon.plans.compile import condition
from quillon.plans.explain import explain
from quillon.plans.policy import parse_softly
from quillon.plans.query import Compare, QueryError, Ref, Text, parse
from quillon.plans.rewrite import gate, leaves, rewrite, widens

UNIQUE = ("card", "printing", "artwork")
PREFER = ("default", "oldest", "newest", "usd_low", "usd_high", "promo")
ORDERS = ("artist", "cmc", "color", "cubecobra", "edhrec", "eur", "name", "power", "rarity", "released", "set", "tix", "toughness", "usd")
#: Orders that run downward unless told otherwise.
DOWNWARD = ("released", "rarity", "usd", "tix", "eur")
DEFAULT_LIMIT = 100
PAGE = 175
_UNIQUE_WORDS = {"card": "card", "cards": "card", "printing": "printing", "prints": "printing", "printings": "printing", "art": "artwork", "artwork": "artwork", "artworks": "artwork"}
_PREFER_WORDS = {"usd-low": "usd_low", "usd-high": "usd_high"}


@dataclass
class Options:
    unique: str = "card"
    prefer: str = "default"
    orderby: str = "edhrec"
    direction: str = "auto"
    limit: int | None = DEFAULT_LIMIT
    offset: int = 0
    include_multilingual: bool = False
    include_extras: bool = False
    include_variations: bool = False
    aliases: dict[str, str] | DataFrame = field(default_factory=dict)
    sets_with_extras: tuple[str, ...] | None = None
    lenient: bool = False


@dataclass
class Result:
    """``rows``: the page, with ``position`` from 0 on; ``matches``: all representatives, for totals."""

    rows: DataFrame
    matches: DataFrame
    options: Options
    explanation: str
    warnings: list[str]

    def total(self) -> int:
        return self.matches.count()


def apply_directives(query, options: Options) -> Options:
    """The options as the query's own directives change them; the last of a kind wins, unknown values are warned of."""
    for d in query.directives:
        words = d.value.replace("-", "_")
        if d.name == "unique" and d.value in _UNIQUE_WORDS:
            options.unique = _UNIQUE_WORDS[d.value]
        elif d.name == "prefer" and _PREFER_WORDS.get(d.value, words) in PREFER:
            options.prefer = _PREFER_WORDS.get(d.value, words)
        elif d.name in ("sort", "order") and d.value in ORDERS:
            options.orderby = d.value
        elif d.name in ("direction", "dir") and d.value in ("asc", "desc", "auto"):
            options.direction = d.value
        else:
            query.warnings.append(f"Unknown value in {d.name}:{d.value}")
    return options


def _checked(o: Options) -> Options:
    for name, value, allowed in (("unique", o.unique, UNIQUE), ("prefer", o.prefer, PREFER), ("orderby", o.orderby, ORDERS), ("direction", o.direction, ("asc", "desc", "auto"))):
        if value not in allowed:
            raise QueryError(f"{name} must be one of {', '.join(allowed)}")
    if o.limit is not None and o.limit < 0 or o.offset < 0:
        raise QueryError("limit and offset must not be negative")
    return o


def prefer_keys(prefer: str) -> list[Column]:
    """What decides which printing stands for a card; the last key is unique."""
    keys = {
        "default": [],
        "oldest": [F.col("released").asc_nulls_last()],
        "newest": [F.col("released").desc_nulls_last()],
        "usd_low": [F.col("price_usd").asc_nulls_last()],
        "usd_high": [F.col("price_usd").desc_nulls_last()],
        "promo": [F.array_contains("is_tags", F.lit("promo")).desc_nulls_last()],
    }[prefer]
    score = F.when(~F.isnan("prefer_score"), F.col("prefer_score")).desc_nulls_last()
    return [*keys, F.col("is_canonical").desc(), score, F.col("scryfall_id").asc()]


def order_keys(orderby: str, direction: str = "auto") -> list[Column]:
    """The keys of an order, then name, rows of the default lane before others, these by language, and id.  Unknown values
    are lowest, but for ranks, where they are highest."""
    down = direction == "desc" or direction == "auto" and orderby in DOWNWARD
    low = lambda c: c.desc_nulls_last() if down else c.asc_nulls_first()
    high = lambda c: c.desc_nulls_first() if down else c.asc_nulls_last()
    keys = {
        "artist": [low(F.col("artist_collated"))],
        "cmc": [low(F.col("cmc"))],
        "color": [low(F.bit_count("color_mask")), low(F.col("color_mask"))],
        "cubecobra": [low(F.col("cubecobra_score"))],
        "edhrec": [high(F.col("edhrec_rank"))],
        "eur": [low(F.col("price_eur"))],
        "name": [low(F.col("name_collated"))],
        "power": [low(F.array_max("powers"))],
        "rarity": [low(F.col("rarity"))],
        "released": [low(F.col("released"))],
        "set": [low(F.col("set_code")), low(F.col("collector_key"))],
        "tix": [low(F.col("price_tix"))],
        "toughness": [low(F.array_max("toughnesses"))],
        "usd": [low(F.col("price_usd"))],
    }[orderby]
    annex = F.when(~F.col("is_canonical"), F.col("lang")).asc_nulls_first()
    return [*keys, F.col("name_collated").asc_nulls_last(), F.col("is_canonical").desc(), annex, F.col("scryfall_id").asc()]


def representatives(df: DataFrame, unique: str, prefer: str) -> DataFrame:
    """One row per card, or per artwork of a card, of those that match; all rows for printings.

    Catalyst keeps each split's best row of a card before the shuffle, so cards with very many printings are no hot spots.
    """
    if unique == "printing":
        return df
    group = [F.col("card_key")]
    if unique == "artwork":
        group.append(F.array_join("artwork", ","))
    chosen = Window.partitionBy(*group).orderBy(*prefer_keys(prefer))
    return df.withColumn("_choice", F.row_number().over(chosen)).where("_choice = 1").drop("_choice")


def page(df: DataFrame, keys: list[Column], limit: int | None, offset: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order, with their ``position``; without a limit all from ``offset`` on.

    A limited page is a top-k in every split and one merge; only the page itself is numbered in one task.
    """
    if limit is None:
        df = df.orderBy(*keys)
        return df.offset(offset) if offset else df
    cut = df.orderBy(*keys).limit(offset + limit)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*keys)) - 1).where(F.col("position") >= offset)


def _words(tree, column: str) -> list[str]:
    """The texts that a tree compares a column with."""
    return sorted({x.right.value.lower() for x in leaves(tree) if isinstance(x, Compare) and isinstance(x.left, Ref) and x.left.field.column == column and isinstance(x.right, Text)})


def _sets_with_extras(prepared: DataFrame, written, o: Options) -> tuple[str, ...]:
    """Those of the sets that the query names which hold extra rows."""
    if o.sets_with_extras is not None or o.include_extras:
        return o.sets_with_extras or ()
    named = _words(written, "set_code")
    if not named:
        return ()
    found = prepared.where(F.col("set_code").isin(named) & F.array_contains("is_tags", F.lit("extra"))).select("set_code").distinct()
    return tuple(r["set_code"] for r in found.collect())


def _aliases(tree, known: dict[str, str] | DataFrame) -> dict[str, str]:
    """What the tags that the query names stand for."""
    if isinstance(known, dict):
        return known
    named = sorted({slug_text(w) for c in ("oracle_tags", "art_tags") for w in _words(tree, c)})
    return {r["alias"]: r["slug"] for r in known.where(F.col("alias").isin(named)).collect()} if named else {}


def search(prepared: DataFrame, query: str, **options) -> Result:
    """The page of a query over a prepared table.  Options: see ``Options``; the query's directives go before them.
    ``aliases`` of tags may be a table (alias, slug), of which only what the query names is read; which of the sets that
    the query names hold extras is looked up unless ``sets_with_extras`` says so.
    ``lenient`` leaves out terms that cannot be honoured, with warnings (``plans.policy``), instead of raising.

    First the filter, then the choice of a representative among what it kept, then order and page.
    """
    parsed = (parse_softly if options.get("lenient") else parse)(query)
    written = parsed.tree
    parsed = rewrite(parsed)
    o = _checked(apply_directives(parsed, Options(**options)))
    tree = gate(parsed, written, o.include_extras, o.include_variations, _sets_with_extras(prepared, written, o))
    keep = condition(tree, _aliases(tree, o.aliases))
    if not (o.include_multilingual or widens(parsed.tree)):
        keep = keep & F.col("is_canonical")
    matches = representatives(prepared.where(keep), o.unique, o.prefer)
    return Result(page(matches, order_keys(o.orderby, o.direction), o.limit, o.offset), matches, o, explain(parsed.tree), parsed.warnings)


def sample(prepared: DataFrame, query: str, n: int, seed: int = 0, **options) -> DataFrame:
    """``n`` cards drawn at random from those that match, each by its preferred printing; the same for the same seed."""
    if not 1 <= n <= 1000:
        raise QueryError("a sample has 1 to 1000 cards")
    drawn = search(prepared, query, **options).matches
    key = F.xxhash64(F.lit(seed), "scryfall_id")
    return drawn.orderBy(key, "scryfall_id").limit(n)


def listing(prepared: DataFrame, number: int = 1) -> DataFrame:
    """Page ``number`` of all printings by name."""
    return search(prepared, "", unique="printing", orderby="name", limit=PAGE, offset=(max(1, number) - 1) * PAGE, include_extras=True).rows
