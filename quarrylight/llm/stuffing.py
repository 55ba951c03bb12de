"""Keyword-stuffed and link-list pages.

A text is cut into paragraphs (short ones in a row are one), a paragraph into
windows of words.  Of the content words that stand at least three times in a
window three things are measured: how much of the window they are (recurrence),
how far the gaps from each to the next of its kind differ (spread), and how often
the word at a lag is the same word, for each lag (positional autocorrelation).
A window is stuffed

* if most of it recurs, closer than prose repeats itself, or
* if fewer words recur, but at gaps that hardly differ, so that the
  autocorrelation has one lag far above the mean of all lags.

The same gaps, without a bound on the lag, are measured over whole long
paragraphs, for lists of keywords that start again after many words.  Links, link
anchors and tags are taken as marked up; a paragraph of distinct nouns without
function words counts too.  The page is flagged when more than half of its text
is of these kinds.

Languages: recurrence needs no word list.  The noun rule wants words of which
hardly any is short or a known function word and that are set apart by spaces,
so prose of a language that is not listed is no list of nouns.

The limits were set on the gap statistics of windows: in running text at most half
of a window recurs, with a mean correlation below 0.05; pages written for
keywords have more than 0.08.

One pass of ``mapInPandas``; nothing is shuffled.

Cases: rows with a null key are left out; null and empty texts are not flagged; closed fences of code, symbol indexes and
links that a sentence describes count as prose; any length of text is read
whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LAGS = 64, 32
LEAST_WORDS = 8
# Recurrence of a dense window, of a dense one of few words, and its mean correlation, with few or many function words; the peak, its height over the mean and the spread of a regular one; the recurrence and equal gaps of a list that starts again.
DENSE, DENSE_FEW, FEW, DENSE_MEAN, DENSE_PROSE = 0.45, 0.28, 24, 0.05, 0.08
PEAK, OVER_MEAN, SPREAD, PLAIN, AGAIN = 0.12, 4.0, 0.25, 0.10, 0.5
# Of a list of nouns: distinct words, known function words, and words of up to three letters.
DISTINCT, KNOWN, SHORT = 0.5, 0.02, 0.12
LINKED, TAGGED, SYMBOLS, DESCRIBED, SHARE = 0.6, 0.6, 0.3, 0.15, 0.5
# Function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    (
        "a an the this that these those some any each every both all no not nor neither either of for to from in on at by with without into onto over under up out off down about after before between through "
        "and or but if when whenever while so as than then because since until although though whereas yet only once more is are was were be been being am it its we us our you your they them their he his she her i my "
        "has have had do does did can could would should will shall must may might there here who which what whose how why where now too also just very such same other own most "
        "el la los las un una unos unas de del al y e o que en se su sus con por para lo es son fue no ni si como más pero sin sobre cada también mientras entre ya cuando este esta después "
        "le les des du et est sont dans pas ne une qui sur au aux par pour ce cette ces il elle ils nous vous leur leurs sans mais ou où donc chaque tant plus avec ensuite tout toute "
        "der die das dem den ein eine einen einer und ist sind nicht zu von vom mit auf im für sich auch wird werden wenn oder aber bei aus nach wie nur noch wir sie er es dass jede jeden jeder solange ohne danach bis"
    ).split()
)
_WORD = re.compile(r"[^\W_]+(?:[_'’-][^\W_]+)*")
_FENCE = re.compile(r"(?s)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", re.M)
_GAP = re.compile(r"\n[^\S\n]*\n\s*")
_LINK = re.compile(r"(?s)<a\s[^<>]*href[^<>]*>.*?</a>|!?\[[^\[\]\n]*\]\([^()\s]*\)|\[[^\[\]\n]*\]:\s*\S+|<?https?://[^\s<>()]+>?|www\.[^\s<>()]+")
_TAG = re.compile(r"(?<![\w#])#[^\W_][\w-]*|\[[^\[\]\n]{1,60}\](?!\()|(?<!\S)[^\W_]+(?:\+[^\W_]+)+(?!\S)")
_SYMBOL = re.compile(r"\w+::\w+|\w+\(\)|\w+[./\\]\w+\.\w+:\d+|\w+\.\w{1,4}:\d+|\b[a-z]+_[a-z_]+\b")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)|[。！？｡।؟]")
# Scripts that do not set words apart by spaces (Han, kana, Thai, Lao, Khmer, Burmese).
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


def places_of(words: list[str]) -> list[np.ndarray]:
    """The places of each content word that stands at least three times."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w not in FUNCTION_WORDS:
            places.setdefault(w, []).append(i)
    return [np.array(p) for p in places.values() if len(p) >= 3]


def lag_profile(places: list[np.ndarray], n: int) -> np.ndarray:
    """At lag 1, 2, ... of ``n`` words: the share of places whose word stands again that many words on."""
    x = -1 - np.arange(n)
    for i, p in enumerate(places):
        x[p] = i
    lags = min(LAGS, n // 2)
    return np.array([(x[lag:] == x[:-lag]).mean() for lag in range(1, lags + 1)]) if lags else np.zeros(1)


def gap_spread(places: list[np.ndarray]) -> float:
    """How far the gaps between equal words differ from their mean, as a share of it; 1 is what chance gives rare words."""
    gaps = [np.diff(p) for p in places]
    return float(sum(len(p) * g.std() / g.mean() for p, g in zip(places, gaps)) / sum(map(len, places)))


def stuffed_window(words: list[str]) -> bool:
    """True if content words recur too much, or too regularly."""
    n = len(words)
    if n < LEAST_WORDS or sum(c for c in Counter(words).values() if c >= 3) < PEAK * n:  # no lag can have a higher share
        return False
    places = places_of(words)
    recurring = sum(map(len, places)) / n
    if recurring < PEAK:
        return False
    profile = lag_profile(places, n)
    mean, peak = float(profile.mean()), float(profile.max())
    plain = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    if recurring >= (DENSE_FEW if n < FEW else DENSE) and mean >= (DENSE_MEAN if plain < 2 * PLAIN else DENSE_PROSE):
        return True
    return plain < PLAIN and peak >= max(PEAK, OVER_MEAN * mean) and gap_spread(places) <= SPREAD


def starts_again(words: list[str]) -> bool:
    """True if most of a long paragraph are content words that come back after one and the same number of words."""
    n = len(words)
    if n < 2 * WINDOW or sum(map(FUNCTION_WORDS.__contains__, words)) >= PLAIN * n:
        return False
    places = places_of(words)
    if sum(map(len, places)) < AGAIN * n:
        return False
    return int(np.bincount(np.concatenate([np.diff(p) for p in places])).max()) >= AGAIN * n * 2 / 3  # a word that stands three times has two gaps


def noun_list(words: list[str], rest: str) -> bool:
    """True for a long line of distinct words without sentences, function words or short words, in a script that sets words apart."""
    n = len(words)
    if n < 2 * LEAST_WORDS or _SENTENCE.search(rest) or max(map(len, rest.split("\n"))) <= 80 or _UNSPACED.search(rest):
        return False
    named = [w for w in words if not w.isdecimal()]
    short = sum(len(w) <= 3 for w in named)
    return sum(map(FUNCTION_WORDS.__contains__, words)) <= KNOWN * n and len(set(words)) >= DISTINCT * n and short <= SHORT * n


def tagged_lines(rest: str, words: list[str]) -> bool:
    """True for records of names, numbers and tags, a line each, without sentences."""
    lines = [x for x in rest.split("\n") if x.strip()]
    if len(lines) < LEAST_WORDS // 2 or sum(map(FUNCTION_WORDS.__contains__, words)) > KNOWN * len(words):
        return False
    return sum(len(_TAG.findall(x)) >= 2 for x in lines) >= 0.8 * len(lines) and sum(map(len, _SYMBOL.findall(rest))) < SYMBOLS * sum(map(len, words))


def spam_characters(paragraph: str) -> int:
    """How many characters of a paragraph are stuffing, links or tags."""
    size = len(paragraph)
    rest, links = paragraph, 0
    if "http" in paragraph or "](" in paragraph or "www." in paragraph or "href" in paragraph:
        rest = _LINK.sub(" ", paragraph)
        links = size - len(rest)
    words = _WORD.findall(rest.lower())
    n = len(words)
    if links >= LINKED * size and (n < LEAST_WORDS or sum(map(FUNCTION_WORDS.__contains__, words)) < 0.1 * n):
        return size
    if "#" in rest or "[" in rest or "+" in rest:
        tags = _TAG.findall(rest)
        if len(tags) >= LEAST_WORDS // 2 and (sum(map(len, tags)) >= TAGGED * sum(map(len, rest.split())) or tagged_lines(rest, words)):
            return size
    if n < LEAST_WORDS:
        return links
    stuffed = n if starts_again(words) else sum(len(words[k : k + WINDOW]) for k in range(0, n, WINDOW) if stuffed_window(words[max(0, min(k, n - WINDOW)) : k + WINDOW]))
    nouns = not stuffed and noun_list(words, rest)
    if not stuffed and not nouns:
        return 0 if sum(map(FUNCTION_WORDS.__contains__, words)) >= DESCRIBED * n else links  # sentences describe their links
    symbols = sum(map(len, _SYMBOL.findall(rest)))
    if symbols >= SYMBOLS * sum(map(len, words)):
        return links  # an index of symbols, or code
    return size if nouns else round((size - links) * stuffed / n) + links


def paragraphs(text: str) -> list[str]:
    """The paragraphs, those of a few words in a row as one."""
    out: list[str] = []
    brief = False
    for p in map(str.strip, _GAP.split(text)):
        few = len(p) < 200 and len(p.split()) < LEAST_WORDS and "://" not in p and "[" not in p
        if few and brief:
            out[-1] += "\n" + p
        else:
            out.append(p)
        brief = few
    return out


def spam_share(text: str | None) -> float:
    if not text or not text.strip():
        return 0.0
    whole = sum(map(len, text.split())) or 1
    prose = _FENCE.sub("\n\n", text) if "```" in text or "~~~" in text else text
    spam = 0.0
    for p in paragraphs(prose):
        if p:
            got = spam_characters(p)
            if got:
                spam += got / len(p) * sum(map(len, p.split()))
    return spam / whole


def score_pages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``key, spam_share, stuffed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = [spam_share(t) for t in b["t"]]
            yield pd.DataFrame({key: b["k"], "spam_share": share, "stuffed": [s > SHARE for s in share]})

    schema = f"`{key}` {dict(documents.dtypes)[key]}, spam_share double, stuffed boolean"
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull()).mapInPandas(run, schema)
