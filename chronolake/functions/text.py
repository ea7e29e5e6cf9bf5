"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.entities import html5
from functools import reduce
from html.parser import HTMLParser
from itertools import islice
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions.scalars import once

# What each masking level replaces, in this order, and by what.
INSTITUTIONS = ("Federal Reserve", "Federal Open Market Committee", "FOMC", "Fed", "Committee")
PEOPLE = ("Powell", "Yellen", "Bernanke", "Greenspan")
YEARS = tuple(str(y) for y in range(1996, 2026))
MASKS = ((INSTITUTIONS, "Central Bank A"), (PEOPLE, "Official A"), (YEARS, "[YEAR]"))
# Upper-case tokens that aren't tickers.
STOPWORDS = frozenset(
    "A I DD THE CEO CFO US USA ETF IPO AI EPS PE ATH YOLO FOMO IMO TLDR EDIT OP WSB FED SEC GDP CPI EOD AH PM IV OTM ITM LOL "
    "TA PT EOY RSI MACD API OK NOT ALL BUY SELL HOLD CALL PUT PUTS IT ON TO BE OR".split()
)
# Words of a tightening and of an easing stance, and marks of time that a contaminated model may recall.
HAWKISH = ("inflation", "raise", "tighten", "hike", "elevated", "robust", "strong")
DOVISH = ("slowdown", "cut", "recession", "downside", "accommodate", "weak", "lower")
ANCHORS = ("199", "200", "201", "202", "Federal Reserve", "FOMC", "Committee", "Powell", "Yellen", "Fed")
ANONYMOUS = ("Central Bank", "[YEAR]", "Official")
BREAKS = ("\n\n", ". ")  # where a chunk may end
RATINGS = ("BUY", "OVERWEIGHT", "HOLD", "UNDERWEIGHT", "SELL")


def mask(text: Column, level: int) -> Column:
    """Cumulative, case-sensitive replacement of institutions, people and years."""
    for names, to in MASKS[:level]:
        for x in names:
            text = F.replace(text, F.lit(x), F.lit(to))
    return text


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Arrow's own kernel decomposes without composing again; texts that are normal already are only looked at, some at a time."""
    parts, same = [], True
    for at in range(0, len(s), 128):
        part = s.slice(at, 128)
        texts = part.to_pylist()
        if not all(t is None or unicodedata.is_normalized("NFKC", t) for t in texts):
            part, same = pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts], s.type), False
        parts.append(part)
    return s if same else pa.concat_arrays(parts)


class _Filing(HTMLParser):
    """Collects what a reader of a filing sees: no hidden header, script or style; an end of a block ends a line."""

    HIDDEN = frozenset(("ix:header", "script", "style"))
    LINES = frozenset(("p", "div", "tr", "table", "li", "h1", "h2", "h3", "h4", "h5", "h6"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        self.out.append("\n" if tag in self.LINES and not self.hidden else " ")

    def handle_startendtag(self, tag, attrs):
        self.out.append(" ")

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def only_closed(raw: str) -> str:
    """`raw` without the opening tags of hidden elements that no closing tag follows: they hide nothing."""
    for tag in _Filing.HIDDEN:
        shut = max((m.start() for m in re.finditer(f"(?i)</{tag}", raw)), default=0)
        raw = raw[:shut] + re.sub(f"(?i)<{tag}(?![\\w:-])[^>]*>", " ", raw[shut:])
    return raw


def _whole(m: re.Match) -> str:
    name = m[1] or ""
    return m[0] if name.startswith("#") or name in html5 else "&amp;" + m[0][1:]


def filing_text(raw: str, bare: bool = True) -> str:
    """What a reader of a filing sees; without `bare`, character references that no semicolon ends stay as they are written."""
    reader = _Filing()
    if not bare:
        raw = re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|\w+;)?", _whole, raw)
    reader.feed(only_closed(raw))
    reader.close()
    blanks = re.sub("[ \t\u00a0]+", " ", "".join(reader.out))
    return re.sub("\n{3,}", "\n\n", blanks).strip()


def strip_html(raw: Column, bare: bool = True) -> Column:
    """Filing markup to text; Spark has no parser for it, so it runs in Arrow batches."""

    @F.arrow_udf(T.StringType())
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([None if r is None else filing_text(r, bare) for r in texts.to_pylist()], pa.string())

    return told(raw)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def text_hash(text: Column, normalise: bool = True) -> Column:
    return F.sha2(squeeze(nfkc(text) if normalise else text).cast("binary"), 256)


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def head(text: Column, n: int, mark: str = " …") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def one_line(text: Column, n: int) -> Column:
    t = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def digest(sections: dict[str, Column], n: int = 500) -> Column:
    """Labelled, trimmed starts of the sections that have text."""
    return F.concat_ws("\n", *[F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{k}: "), F.substring(strip(c), 1, n))) for k, c in sections.items()])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mentions(text: Column) -> Column:
    """Tokens that may be tickers: cashtags in either case, and upper-case words of 2 to 5 letters that aren't stop words."""
    found = F.regexp_extract_all(text, F.lit(r"\$[A-Za-z]{1,5}\b|\b[A-Z]{2,5}\b"), 0)
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    told = F.filter(found, lambda t: t.startswith("$") | ~F.array_contains(stop, t))
    return F.transform(told, lambda t: F.upper(F.ltrim(t, F.lit("$"))))


def about(text: Column, title: Column, ticker: Column) -> Column:
    """Whether a post is about a ticker: its cashtag in text or title, the word in the title, or no other token oftener in the text."""
    word = F.concat(F.lit("\\Q"), ticker, F.lit("\\E"))
    cash, bare = F.concat(F.lit(r"(?i)\$"), word, F.lit(r"\b")), F.concat(F.lit(r"(?i)\b"), word, F.lit(r"\b"))
    tokens = mentions(F.coalesce(text, F.lit("")))
    own = F.size(F.filter(tokens, lambda t: t == F.upper(ticker)))
    rest = F.filter(tokens, lambda t: t != F.upper(ticker))
    most = F.coalesce(F.array_max(F.transform(F.array_distinct(rest), lambda t: F.size(F.filter(rest, lambda x: x == t)))), F.lit(0))
    told = F.coalesce(F.regexp_like(text, cash), F.lit(False)) | F.coalesce(F.regexp_like(title, cash), F.lit(False)) | F.coalesce(F.regexp_like(title, bare), F.lit(False))
    return told | (own > 0) & (own >= most)


def parse_signal(text: Column) -> Column:
    """Struct of signal, confidence (0.70 if absent, clamped to 0.5..1) and horizon (1-5d if absent); null without a signal."""
    one = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    s = F.upper(one(r"(?i)Signal:\s*(BUY|OVERWEIGHT|HOLD|UNDERWEIGHT|SELL)"))
    c = F.coalesce(one(r"(?i)Confidence:\s*(0\.\d+|1\.0+)").cast("double"), F.lit(0.7))
    h = F.coalesce(one(r"(?i)Horizon:\s*(1-5d|5-20d|20d\+)"), F.lit("1-5d"))
    return F.when(s.isNotNull(), F.struct(s.alias("signal"), F.least(F.lit(1.0), F.greatest(F.lit(0.5), c)).alias("confidence"), h.alias("horizon")))


def signal_or_hold(answer: Column) -> Column:
    """A one-word answer as a rating; anything else is HOLD."""
    word = F.upper(strip(answer))
    return F.when(word.isin(*RATINGS), word).otherwise("HOLD")


def tagged(text: Column, tag: str) -> Column:
    """The trimmed content of an XML-like block, null if absent."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def judge_directives(text: Column) -> Column:
    """Struct (bull, bear) of a judge's two directives; null unless both are there."""
    bull, bear = (F.regexp_extract(text, f"(?is)<{t}_directive>(.*?)</{t}_directive>", 0) for t in ("bull", "bear"))
    inner = lambda t: strip(F.regexp_replace(t, r"(?is)^<[a-z_]+>|</[a-z_]+>$", ""))
    return F.when((bull != "") & (bear != ""), F.struct(inner(bull).alias("bull"), inner(bear).alias("bear")))


def digest_bytes(text: Column) -> Column:
    """The 32 bytes of a SHA-256 as numbers in [-1, 1)."""
    byte = lambda h, j: (F.conv(h.substr(2 * j + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128
    return once(F.sha2(text.cast("binary"), 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: byte(h, j)))


def hash_vector(text: Column, n: int, seed: int = 42) -> Column:
    """n numbers in [-1, 1): the bytes of digests of seed, chunk number and text."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // 32)), lambda c: digest_bytes(F.concat_ws(":", F.lit(str(seed)), c.cast("string"), text)))
    return F.slice(F.flatten(chunks), 1, n)


def noise(text: Column, seed: int = 42) -> Column:
    """A number in [-1, 1) from the first byte of a digest."""
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:scalar:"), text).cast("binary"), 256), 1, 2), 16, 10).cast("double") - 128) / 128


def stance_probabilities(text: Column, seed: int = 42, competence: float = 0.75, dose: float = 0.0, future: Column | None = None) -> Column:
    """P(dovish, neutral, hawkish) from key words, some noise, and, with a dose, recall of what came after at marks of time."""
    has = lambda words, t: reduce(or_, (F.contains(t, F.lit(w)) for w in words))

    def scored(t: Column) -> Column:
        swing = once(noise(t, seed), lambda n: F.when(F.abs(n) > competence, n * 0.4).otherwise(0.0))
        score = once(F.lower(t), lambda low: has(HAWKISH, low).cast("double") - has(DOVISH, low).cast("double")) + swing
        if dose > 0 and future is not None:
            recalled = has(ANCHORS, t) & ~has(ANONYMOUS, t)
            score = score + F.when(recalled, dose * 1.5 * F.coalesce(future.cast("double"), F.lit(0.0))).otherwise(0.0)
        return score

    score = once(text, scored)  # a masked text is made once, not by each of its readers
    e = once(score, lambda s: F.array(F.exp(s * -1.5), F.exp(0.2 - 0.5 * F.abs(s)), F.exp(s * 1.5)))
    return once(e, lambda v: F.transform(v, lambda x: x / (v[0] + v[1] + v[2])))


def stance_score(p: Column) -> Column:
    return p[2] - p[0]


def spans(text: str, size: int = 1800, overlap: int = 200) -> Iterator[tuple[int, int]]:
    """Start and end of overlapping chunks of at most `size` code points.

    A chunk ends after the last paragraph or sentence break in its later half, or is full.  Where a chunk that starts
    at some place ends depends on that place only, so the ends of all places are looked up at once in a table of each
    place's last break, and the chunks are the path from place 0.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(codes))
    breaks = np.zeros(len(codes), bool)
    for one, two in BREAKS:
        breaks[:-1] |= (codes[:-1] == ord(one)) & (codes[1:] == ord(two))
    last = np.maximum.accumulate(np.where(breaks, place, -1))
    ends = np.minimum(place + size, len(codes))
    broken = last[np.maximum(ends - 2, 0)]  # the break's second character lies in the chunk, too
    ends = np.where((ends < len(codes)) & (broken > place + size // 2), broken + 1, ends)
    after = np.where(ends < len(codes), np.maximum(place + 1, ends - overlap), len(codes))
    at = 0
    while at < len(codes):
        yield at, int(ends[at])
        at = int(after[at])


def pieces(text: str, size: int = 1800, overlap: int = 200, most: int | None = 600) -> list[str]:
    """The trimmed texts of the first `most` spans (all, if not given), without empty ones."""
    return [x for a, b in islice(spans(text, size, overlap), most) if (x := text[a:b].strip())]


def chunks(text: Column, size: int = 1800, overlap: int = 200, most: int | None = 600) -> Column:
    """An array of `pieces`, in Arrow batches: where a chunk ends depends on the one before."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(s: pa.Array) -> pa.Array:
        return pa.array([pieces(t or "", size, overlap, most) for t in s.to_pylist()], pa.list_(pa.string()))

    return cut(text)
