"""Pages of repeated keywords, link lists, product and tag lists instead of sentences.

A page is cut into lines, and long lines into sentences or runs of about twenty words.  Every line becomes one symbol
from a few counts: words in links, function words, words that the page repeats, marks of lists and prices, how a
sentence ends.  A hidden Markov model with the states prose, link list, tag list and menu labels the lines; a page is
flagged if lines that are not prose hold more than half of its words.

The model is fitted here, by expectation maximisation from a prior, on the symbols of all pages.  Pages are turned into
symbols once; fitting and labelling read the table of symbols.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import drop, materialise, ship_code

PROSE, LINKS, TAGS, MENU = range(4)
STATES = ("prose", "link_list", "tag_list", "menu")
#: A language without listed function words: its short words in lower case tie sentences together, up to so many letters in
#: Latin script and in others.
SHORT_LATIN, SHORT_OTHER = 2, 3
#: Strength of the prior against the pages, in lines.
PRIOR_LINES = 3000.0
FIT_ROUNDS = 8
#: Words of a run into which a line without sentences is cut.
RUN = 20

# Frequent function words of the languages that the corpus names.
FUNCTION_WORDS = frozenset(
    """
    a an the of in on at to for from by with and or but nor that which this these those it its is was are were be been as if
    when while because than then i you we they he she his her their our my your not only so though unless until into over about
    how what who has have had do does did can could would should may might will must there here's it's don't
    el la los las un una unos unas de en y e o u que se con por para su sus es no lo al del cuando si más le les como pero
    muy ya sin sobre entre porque hasta mientras aunque
    der die das den dem des ein eine einen einem einer und oder ist sind war mit für von im zu auf nicht wenn wie sich es hat
    haben auch nach bei aus an als weil bis nur noch solange zum zur kaum wurde fast immer
    le les une des du au aux et ou est sont qui dans pour sur pas avec ne ce cette il elle on plus jusqu'à après selon
    os as um uma uns umas em com não do da dos das no na nos nas se mas mais porque até embora seu sua ao à já
    il lo gli uno di e che per non del della dei delle nel nella più al alla ma come sono dal dopo con fino perché così mio
    """.split()
)
# Function words that stand inside names, between words in capitals.
NAME_WORDS = frozenset("of the to in at on de du des la le les el los von der den da do dos del della di".split())
# Shop phrases whose small words make no sentence.
SHOP_PHRASES = ("in stock", "out of stock", "sold out", "add to cart", "add to basket", "buy now", "free shipping", "pas cher", "en stock")

# Characters that tie Chinese sentences together, and syllables with which Korean words do.
HAN_TIES, HANGUL_TIES = "的了是在和不有这這就也与與", tuple("은는이가을를에의도로와과서다요고")

# An address by its grammar: a scheme or www, or a host of two or more labels in lower case, the last one of letters.
_URL = re.compile(r"(?i:https?://|www\.)[^\s<>\"'\])]+|(?<![\w@.\-])(?:[a-z0-9][a-z0-9\-]+\.)+[a-z]{2,}(?:/[^\s<>\"'\])]*)?(?![\w@])")
_URL_SIGN = re.compile(r"https?://|www\.|[a-z0-9]\.[a-z]{2}", re.I)
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>|\[([^\]\n]*)\]\(([^)\s]*)\)|\[url=[^\]]*\](.*?)\[/url\]", re.I | re.S)
_TAG = re.compile(r"</?[a-zA-Z][^>\n]*>")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
# Han with their compatibility forms, Hiragana and Katakana with the mark of long vowels.
_HAN_KANA = r"々〇㐀-䶿一-鿿豈-﫿ぁ-ゟ゠-ヿｦ-ﾟ"
_CJK = re.compile(rf"[{_HAN_KANA}]+")
_CJK_OR_NOT = re.compile(rf"[{_HAN_KANA}]+|[^{_HAN_KANA}]+")
_PARTICLE = re.compile(r"[はがをにでとのもへ]")
_HIRAGANA = re.compile(r"[ぁ-ゟ]")
_HAN_TIE = re.compile(rf"[{HAN_TIES}]")
_HANGUL = re.compile(r"[가-힣]")
_STOP = re.compile(r"[.!?…][\"'”’)]?(?=\s)|[。！？]")
_STOPS, _CLOSERS = tuple(".!?…。！？"), "\"'”’)]"
_PRICE = re.compile(r"(?:[$€£¥]\s?\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s?(?:usd|eur|gbp|jpy|pts|tix|円|€|\$|£)(?!\w))", re.I)
_SEPARATORS = (*",;|·•\t#>»/", " - ", " – ", " — ")
_COUNT = re.compile(r"\(\d+\)|\bx\d+\b|\b\d+x\b", re.I)
_SHOP = re.compile("|".join(rf"\b{p}\b" for p in SHOP_PHRASES), re.I)
_SYMBOL = re.compile(r"\{[^{}\s]{1,5}\}")
_DIGIT = re.compile(r"\d")

#: The symbol of a line: links (none, some, most), function words (none, few, many), repetition (low, high), marks of
#: lists (few, many), end of a sentence (no, yes), length (short, long).
SHAPE = (3, 3, 2, 2, 2, 2)
SYMBOLS = int(np.prod(SHAPE))


def _unwrapped(text: str) -> Iterator[str]:
    """The lines, those that go on in lower case joined with what they go on from; marks of quoting dropped."""
    held = ""
    for line in text.splitlines():
        line = line.strip().lstrip("> ")
        if not line:
            continue
        if held and line[0].islower() and not held.endswith(_STOPS):
            held = f"{held} {line}"
            continue
        if held:
            yield held
        held = line
    if held:
        yield held


def _lines(text: str) -> Iterator[str]:
    for line in _unwrapped(text):
        if line.count(" ") <= RUN and len(line) <= 400:
            yield line
            continue
        for sentence in _STOP.sub("\\g<0>\n", line).split("\n"):
            pieces = sentence.strip().split(" ")
            size = -(-len(pieces) // -(-len(pieces) // RUN))  # runs of about equal length, at most RUN
            for lo in range(0, len(pieces), size):
                run = " ".join(pieces[lo : lo + size])
                if run.strip():
                    yield run


def _words(text: str, cjk: bool) -> list[str]:
    """Words as written; unspaced scripts count a word for two characters."""
    found = _WORD.findall(text)
    if not cjk:
        return found
    out = []
    for w in found:
        for run in _CJK_OR_NOT.findall(w):
            out += [run[i : i + 2] for i in range(0, len(run), 2)] if _CJK.match(run) else [run]
    return out


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The symbols and the numbers of words of a page's lines."""
    text = text or ""
    low = text.lower()
    # what the page holds nowhere need not be looked for in its lines
    cjk = _CJK.search(text) is not None
    anchors, tags = "<a" in low or "](" in low or "[url" in low, "<" in text
    urls_at_all, shop = _URL_SIGN.search(text) is not None, any(p in low for p in SHOP_PHRASES)
    digits, symbols_at_all = _DIGIT.search(text) is not None, "{" in text
    separators = [s for s in _SEPARATORS if s in text]
    cut = []
    # a sentence that is said again is no keyword: where function words tie a line together it counts once
    seen: Counter = Counter()
    known: set[str] = set()
    listed = 0
    for line in _lines(text):
        rest, linked = line, 0
        if anchors:
            labels = [next((g for g in m.groups()[:2] + m.groups()[3:] if g), "") for m in _ANCHOR.finditer(line)]
            if labels:
                rest = _ANCHOR.sub(" ", line)
                linked = len(labels) + sum(len(_words(_TAG.sub(" ", x), cjk)) for x in labels)
        if urls_at_all:
            rest, urls = _URL.subn(" ", rest)
            linked += urls
        if tags:
            rest = _TAG.sub(" ", rest)
        if symbols_at_all:
            rest = _SYMBOL.sub(" ", rest)
        words = _words(rest, cjk)
        lowered = list(map(str.lower, words))
        small = _function_words(rest, words, lowered, cjk, shop)
        listed += small
        cut.append((line, rest, words, lowered, linked, small))
    if not listed:
        # no listed word in the whole page: perhaps a language that has none listed
        cut = [(line, rest, words, lowered, linked, _short_words(line, words)) for line, rest, words, lowered, linked, _ in cut]
    for line, _, _, lowered, _, small in cut:
        if not small or line not in known:
            known.add(line)
            seen.update(lowered)
    often = max(4, 0.02 * seen.total())
    repeat = {w for w, n in seen.items() if n >= often} - FUNCTION_WORDS
    symbols, sizes = [], []
    for line, rest, words, lowered, linked, small in cut:
        n = len(words) + linked
        if not n:
            continue
        marks = sum(map(rest.count, separators))
        if digits and _DIGIT.search(rest):
            marks += 2 * len(_COUNT.findall(rest)) + 3 * len(_PRICE.findall(rest))
        share, size = linked / n, max(1, len(words))
        # mixed radix in the order of SHAPE
        code = 0 if share < 0.25 else 1 if share < 0.7 else 2
        code = code * 3 + (0 if small == 0 else 1 if small < 0.1 * len(words) else 2)
        code = code * 2 + (bool(repeat) and sum(map(repeat.__contains__, lowered)) > 0.6 * size)
        code = code * 2 + (marks >= 2 and marks >= 0.2 * size)
        code = code * 2 + line.rstrip().rstrip(_CLOSERS).endswith(_STOPS)
        symbols.append(code * 2 + (len(words) > 6))
        sizes.append(n)
    return np.array(symbols, np.uint8), np.array(sizes, np.uint32)


def _short_words(line: str, words: list[str]) -> int:
    """What ties a sentence of a language without listed words together: short words in lower case; in Korean the endings
    of words.  A line that ends like no sentence has none."""
    if not line.rstrip().rstrip(_CLOSERS).endswith(_STOPS):
        return 0
    n = 0
    for w in words:
        if _HANGUL.match(w):
            n += len(w) > 1 and w.endswith(HANGUL_TIES)
        else:
            n += w.islower() and w.isalpha() and len(w) <= (SHORT_LATIN if w[0] < "\u0250" else SHORT_OTHER)
    return n


def _function_words(rest: str, words: list[str], lowered: list[str], cjk: bool, shop: bool) -> int:
    """Function words that tie a sentence together: not those inside names, nor in shop phrases."""
    if cjk and _CJK.search(rest):
        runs = "".join(_CJK.findall(rest))
        if _PARTICLE.search(runs):
            return len(_HIRAGANA.findall(runs)) // 2
        return 0 if _HIRAGANA.search(runs) else len(_HAN_TIE.findall(runs))
    if shop and _SHOP.search(rest):
        words = _words(_SHOP.sub(" ", rest), cjk)
        lowered = list(map(str.lower, words))
    n, last = 0, len(words) - 1
    for i in [i for i, w in enumerate(lowered) if w in FUNCTION_WORDS]:
        w = lowered[i]
        if words[i] == w:
            n += not (w in NAME_WORDS and i and i < last and words[i - 1][0].isupper() and words[i + 1][0].isupper())
        else:
            n += i == 0 and last > 0 and words[1][0].islower()
    return n


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission probabilities before any page is seen."""
    emit = np.empty((4, SYMBOLS))
    for code in itertools.product(*map(range, SHAPE)):
        link, small, again, marks, end, long = code
        p = [
            (0.75, 0.22, 0.03)[link] * (0.07, 0.18, 0.75)[small] * (0.9, 0.1)[again] * (0.92, 0.08)[marks] * (0.25, 0.75)[end] * (0.3, 0.7)[long],
            (0.02, 0.13, 0.85)[link] * (0.8, 0.13, 0.07)[small] * (0.6, 0.4)[again] * (0.7, 0.3)[marks] * (0.9, 0.1)[end] * (0.7, 0.3)[long],
            (0.93, 0.05, 0.02)[link] * (0.8, 0.16, 0.04)[small] * (0.35, 0.65)[again] * (0.5, 0.5)[marks] * (0.8, 0.2)[end] * (0.3, 0.7)[long],
            (0.9, 0.07, 0.03)[link] * (0.86, 0.1, 0.04)[small] * (0.6, 0.4)[again] * (0.3, 0.7)[marks] * (0.93, 0.07)[end] * (0.6, 0.4)[long],
        ]
        emit[:, np.ravel_multi_index(code, SHAPE)] = p
    emit /= emit.sum(1, keepdims=True)
    move = np.full((4, 4), 0.01) + np.eye(4) * 0.96
    return np.array([0.94, 0.02, 0.02, 0.02]), move, emit


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def posterior(symbols: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of each state, and the expected transitions, each page ``times`` over, by forward-backward.

    ``symbols`` holds the lines of pages of these ``lengths`` (none of them 0) one page after the other.  All pages move
    on by a line at a time together, the longer ones first in order, so that those still going on are a beginning.
    """
    order = np.argsort(-lengths, kind="stable")
    first, size = _bounds(lengths)[:-1][order], lengths[order]
    going = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # pages of at least so many lines
    likely = emit.T[symbols]
    ahead, back = np.empty_like(likely), np.ones_like(likely)
    at = start * likely[first]
    for t, k in enumerate(going):
        here = first[:k] + t
        if t:
            at = (at[:k] @ move) * likely[here]
        at = at / at.sum(1, keepdims=True)
        ahead[here] = at
    for t in range(len(going) - 2, -1, -1):
        here = first[: going[t + 1]] + t
        at = (likely[here + 1] * back[here + 1]) @ move.T
        back[here] = at / at.sum(1, keepdims=True)
    state = ahead * back
    state /= state.sum(1, keepdims=True)
    last = np.zeros(len(symbols), bool)
    last[first + size - 1] = True
    from_ = np.flatnonzero(~last)
    weight = np.ones(len(from_)) if times is None else np.repeat(times, lengths)[from_]
    moved = np.zeros((4, 4))
    for lo in range(0, len(from_), 100_000):
        i = from_[lo : lo + 100_000]
        pairs = ahead[i][:, :, None] * move[None] * (likely[i + 1] * back[i + 1])[:, None, :]
        moved += (pairs * (weight[lo : lo + 100_000] / pairs.sum((1, 2)))[:, None, None]).sum(0)
    return state, moved


def expected(symbols: np.ndarray, lengths: np.ndarray, times: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Expected starts, transitions and emissions, one after the other, over pages that occur so many ``times``."""
    if not len(lengths):
        return np.zeros(20 + 4 * SYMBOLS)
    state, moved = posterior(symbols, lengths, *model, times)
    weighted = state * np.repeat(times, lengths)[:, None]
    emitted = [np.bincount(symbols, weighted[:, k], SYMBOLS) for k in range(4)]
    return np.concatenate([weighted[_bounds(lengths)[:-1]].sum(0), moved.ravel(), *emitted])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and how many each value has."""
    values = [np.frombuffer(v, np.uint8) for v in column.to_pylist()]
    return (np.concatenate(values) if values else np.zeros(0, np.uint8)), np.array([len(v) for v in values], np.int64)


def _maximise(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of expected counts, with the prior as ``PRIOR_LINES`` lines more."""
    start0, move0, emit0 = prior()
    s, m, e = start0 * PRIOR_LINES / 10 + sums[:4], move0 * PRIOR_LINES + sums[4:20].reshape(4, 4), emit0 * PRIOR_LINES + sums[20:].reshape(4, SYMBOLS)
    return s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)


def fit(pages: list[np.ndarray], rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation over the symbols of some pages, with the prior as that many lines more."""
    model = prior()
    counted = Counter(p.tobytes() for p in pages if len(p))
    symbols, lengths = _flat(pa.array(list(counted), pa.binary()))
    times = np.array(list(counted.values()), np.float64)
    for _ in range(rounds):
        model = _maximise(expected(symbols, lengths, times, model))
    return model


def shares(text: str | None, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """A page's words, and how many of them lie in lines of each state (by each line's most probable one)."""
    symbols, sizes = encode(text)
    if not len(symbols):
        return 0, np.zeros(4, np.int64)
    state = posterior(symbols, np.array([len(symbols)]), *model)[0].argmax(1)
    return int(sizes.sum()), np.bincount(state, sizes, 4).astype(np.int64)


def page_symbols(documents: DataFrame) -> DataFrame:
    """(doc_id, symbols, sizes) of ``documents`` (doc_id, text): a byte a line, and each line's words as four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "symbols", "sizes"])

    ship_code(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, symbols binary, sizes binary")


def fit_model(pages: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model fitted on all ``pages`` (symbols): each round adds up the expected counts of the different sequences of
    symbols, of which one row a partition goes through the driver."""
    different, path = materialise(pages.where("length(symbols) > 0").groupBy("symbols").agg(F.count("*").alias("times")), "symbols")
    model = prior()
    for _ in range(FIT_ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = sum(expected(*_flat(b.column(0)), b.column(1).to_numpy().astype(np.float64), model) for b in batches)
            if np.ndim(sums):
                yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = different.mapInArrow(run, "sums array<double>").collect()
        model = _maximise(np.sum([r["sums"] for r in parts], axis=0) if parts else np.zeros(20 + 4 * SYMBOLS))
    drop(pages.sparkSession, path)
    return model


def page_kinds(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, prose, link_list, tag_list, menu): how many words of each page lie in lines of each kind.

    ``documents`` has ``doc_id, text``.  Null, blank and wordless texts have no words of any kind.  Whole texts are read,
    however long; repeated rows give repeated results; an empty table none.  Other columns are never read.
    """
    pages, _ = materialise(page_symbols(documents), "pages")
    model = fit_model(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, lengths = _flat(batch.column(1))
            some = lengths[lengths > 0]
            state = posterior(symbols, some, *model)[0].argmax(1) if len(some) else np.zeros(0, np.int64)
            size = _flat(batch.column(2))[0].view(np.uint32)
            page = np.repeat(np.arange(batch.num_rows), lengths)
            kinds = np.bincount(page * 4 + state, size, 4 * batch.num_rows).astype(np.int64).reshape(-1, 4)
            words = kinds.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), *(pa.array(np.ascontiguousarray(kinds[:, k])) for k in range(4))], ["doc_id", "n_words", *STATES])

    return pages.mapInArrow(run, "doc_id bigint, n_words bigint, " + ", ".join(f"{s} bigint" for s in STATES))


def list_pages(documents: DataFrame) -> DataFrame:
    """The rows of ``page_kinds`` of which more than half of the words are not prose."""
    return page_kinds(documents).where(F.col("n_words") > 2 * F.col("prose"))
