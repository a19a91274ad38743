"""Problem 8: keyword-stuffed and link-list pages.

Method: a text without its repeats of whole sentences is compressed in blocks of equal size; the mean ratio is compared
with the median and the median deviation of texts of its language and length. Texts of extreme redundancy with few sentence
ends are the seeds. Redundancy alone misses lists of different links or menu entries, and pages where stuffing is
mixed with sentences, so the seeds teach a word model (log odds of a word in stuffed texts, refined over a few
rounds), and a text counts as stuffed if more than half of its characters belong to segments the model takes for
keywords, or to links, tags and menu entries. Texts of extreme redundancy and few sentence ends are reported beside
those when they repeat no whole sentences. A seed alone isn't reported, as clipped notes and repeated sentences are seeds
as well; but in a seed, words too rare for the model speak for stuffing, so keywords of one page are found.

Statistics, seeds, word model and scoring cover all documents. Each text is measured and split once; its words are
kept as slots of a table of fixed size (words of equal hash share one), and a round counts in how many stuffed texts
each slot is. So the counts that come to the driver and the odds that go to every worker (16 MB) don't grow with the
data. Slots in fewer than three texts have no odds.

Defined results: null, empty and blank texts are never stuffed; rows of equal id count once, as stuffed if any is;
whole texts are read, whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.sizes import small_side
from quillstream.session import Scratch

BLOCK_BYTES = 600
LEAST_BLOCK = 150
# The word model has so many slots, whatever the corpus; words are put into them by a hash.
SLOTS = 1 << 22

_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"(?i:https?://|www\.)\S+|#[^\s#]+|(?<!\S)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/\S*)?(?!\S)")
_ENTRY = re.compile(r"\s(?:>|»|›|/|\||::|•)\s")
_CLOSED = re.compile(r"[.!?…][\"'”’»)\]]*$")
# Arrow's expressions: ends of segments, segments that may have links or menu entries, and ends of sentences after a
# letter or digit.
_SPACE = r"[\s\pZ\x{b}\x{1c}-\x{1f}\x{85}]"
_CUT = r"([.!?])" + _SPACE + r"|\n"
_SEAM = "\x01"
_MAY_LINK = r"#|://|(?i:www\.)|\.[a-z]{2}"
_MAY_MENU = r"[>»›/|•]|::"
_END = r"[\pL\pN][.!?…](?:" + _SPACE + "|$)"


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines, and sentences within lines, of all texts of an array, and the text that each belongs to."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, _CUT, "\\1" + _SEAM), _SEAM)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    trimmed = pc.utf8_trim_whitespace(lists.flatten())
    full = pc.not_equal(trimmed, "")
    return trimmed.filter(full), of[full.to_numpy(zero_copy_only=False)]


def redundancy(parts: list[str]) -> float | None:
    """Mean compression ratio of the blocks of a text, by its segments in lower case; whole sentences that repeat are left
    out, repeated lines without a sentence's end stay. A short rest belongs to the block before it, and a short text is
    one block. None if there is nothing but white space."""
    if len(set(parts)) < len(parts):
        seen, kept = set(), []
        for s in parts:
            if s not in seen or not _CLOSED.search(s):
                kept.append(s)
                seen.add(s)
        parts = kept
    body = "\n".join(parts).encode()
    cuts = [*range(0, max(1, len(body) - LEAST_BLOCK + 1), BLOCK_BYTES), len(body)]
    blocks = [body[i:j] for i, j in zip(cuts, cuts[1:])]
    return sum(len(zlib.compress(b, 9)) / len(b) for b in blocks) / len(blocks) if body else None


def _beside(s: str, link: bool, menu: bool) -> tuple[int, bool, str]:
    """Of a segment that may have links or menu entries: the characters of links, whether it is all menu, and the rest."""
    links, rest = 0, s
    if link:
        links = sum(len(m.group()) for m in _LINK.finditer(s))
        rest = _LINK.sub(" ", s)
    if menu:
        words, entries = len(_WORD.findall(rest)), len(_ENTRY.findall(s))
        menu = words > 0 and entries >= 1 and not s.startswith("> ") and words <= 3 * (entries + 1) and entries * 2 + 1 >= words / 2
    return links, menu, rest


SPLIT = "chars array<int>, sure array<int>, counts array<int>, words array<int>, others array<int>"


class _Codes(dict):
    """Slots of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        code = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % SLOTS
        self[word] = code
        return code


def _word_codes(rests: pa.Array, code: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the words of all texts of an array, in order, and the number of words of each text. Each distinct
    run of characters between white space is parted into words once."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(rests))
    found = lists.flatten().dictionary_encode()
    parted = [_WORD.findall(w) for w in found.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, parted), np.int64, len(parted))
    codes = np.fromiter((code(w) for ws in parted for w in ws), np.int32, int(sizes.sum()))
    at = found.indices.to_numpy()
    n = sizes[at]
    row = np.repeat(np.arange(len(rests)), pc.list_value_length(lists).to_numpy())
    # The words of a run follow each other from where the run's first one is.
    first = np.cumsum(sizes) - sizes
    flat = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return codes[flat], np.bincount(row, n, len(rests)).astype(np.int64)


def _measured(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[pa.RecordBatch]:
    """``(id, lang, size, text)`` to ``(id, lang, size, ratio, ends)`` and :data:`SPLIT`: of each segment the characters,
    those that are stuffed whatever its words (links, or all of a menu entry), and the number of words that decide
    about the rest; those words in order; and the text's words beside them."""
    code = _Codes().__getitem__
    for whole in batches:
        for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
            texts, rows = batch.column("text"), batch.num_rows
            if not rows:
                continue
            rests, of = segments(texts)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
            low = pc.utf8_lower(rests).to_pylist()
            ratios = [redundancy(low[i:j]) for i, j in zip(bounds, bounds[1:])]
            runs = np.bincount(of, pc.list_value_length(pc.utf8_split_whitespace(rests)).to_numpy(), rows)
            ends = pc.count_substring_regex(texts, _END).to_numpy() / np.maximum(1, runs)
            chars = pc.utf8_length(rests).to_numpy()
            sure, menus = np.zeros(len(rests), np.int32), np.zeros(len(rests), bool)
            link, menu = (pc.match_substring_regex(rests, p).to_numpy(zero_copy_only=False) for p in (_MAY_LINK, _MAY_MENU))
            if (odd := np.flatnonzero(link | menu)).size:
                flat = rests.to_pylist()
                for i in odd:
                    links, menus[i], flat[i] = _beside(flat[i], link[i], menu[i])
                    sure[i] = chars[i] if menus[i] else links
                    if menus[i]:
                        flat[i] = ""
                rests = pa.array(flat, pa.string())
            words, counts = _word_codes(rests, code)
            last = np.concatenate([[0], np.cumsum(np.bincount(of, counts, rows).astype(np.int64))])
            others: list[list[int]] = [[] for _ in range(rows)]
            for i in np.unique(of[sure > 0]):
                others[i] = sorted(set(map(code, _WORD.findall(texts[i].as_py().lower()))).difference(words[last[i] : last[i + 1]].tolist()))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32)))
            cols = [batch.column(c) for c in ("id", "lang", "size")] + [pa.array(ratios, pa.float64()), pa.array(ends, pa.float64())]
            cols += [lists(chars), lists(sure), lists(counts), pa.ListArray.from_arrays(pa.array(last.astype(np.int32)), pa.array(words)), pa.array(others, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang", "size", "ratio", "ends", "chars", "sure", "counts", "words", "others"])


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and the row that each belongs to."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def shares(batch: pa.RecordBatch, odds: np.ndarray, rare: float, least: float = 0.5) -> np.ndarray:
    """Of each row of a batch with :data:`SPLIT`, the share of the characters in segments whose words have mean log
    odds over ``least``, in menu entries, tags and links. Words in too few texts, whose odds are not a number, have the
    odds ``rare`` in a seed and 0 elsewhere."""
    (chars, row), (sure, _), (counts, _), (words, of) = (_flat(batch, c) for c in ("chars", "sure", "counts", "words"))
    known = odds[words].astype(float)
    known = np.where(np.isnan(known), np.where(batch.column("seed").to_numpy(zero_copy_only=False)[of], rare, 0.0), known)
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), known, len(counts))
    bad = np.where((counts > 0) & (total > least * counts), chars, sure)
    return np.bincount(row, bad, batch.num_rows) / np.maximum(1, np.bincount(row, chars, batch.num_rows))


def word_odds(inside: np.ndarray, every: np.ndarray, stuffed: int, texts: int, limit: float = 3.0) -> np.ndarray:
    """Log odds, within limits, of each word's presence in stuffed texts, with half a text added on either side."""
    odds = np.log((inside + 0.5) / (stuffed + 1)) - np.log((every - inside + 0.5) / (texts - stuffed + 1))
    return np.clip(odds, -limit, limit).astype(np.float32)


def _presence(split: DataFrame, flags: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, int]:
    """In how many flagged texts each slot is, and the number of flagged texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(flags(batch)))
            (words, a), (others, b) = _flat(batch, "words"), _flat(batch, "others")
            place, found = pd.factorize(np.concatenate([words, others]))
            pairs = pd.unique(np.concatenate([a, b]) * max(1, len(found)) + place)
            n = np.bincount(pairs % max(1, len(found)), minlength=len(found))
            cols = [pa.array([*found.tolist(), SLOTS], pa.int32()), pa.array([*n.tolist(), batch.num_rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["w", "n"])

    # No more rows than there are slots, and one.
    got = split.mapInArrow(count, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got.column("w").to_numpy()] = got.column("n").to_numpy()
    return out[:SLOTS], int(out[SLOTS])


def fit_words(split: DataFrame, rounds: int, least_share: float, least_texts: int = 3) -> tuple[np.ndarray, float]:
    """Log odds of the words of each slot, not a number for those in fewer than ``least_texts`` texts, and the odds of a
    word that is in one seed and one text beside the seeds; taught by the rows whose ``seed`` is true and refined by all
    rows."""
    sc = split.sparkSession.sparkContext
    inside, stuffed = _presence(split.filter("seed"), lambda b: np.ones(b.num_rows, bool))
    odds, rare = np.full(SLOTS, np.nan, np.float32), 0.0
    if not stuffed:
        return odds, rare
    every, texts = _presence(split, lambda b: np.ones(b.num_rows, bool))
    one = np.ones(1, np.int64)
    rare = max(0.0, float(word_odds(one, 2 * one, stuffed, texts)[0]))
    for i in range(rounds):
        if i:
            model = sc.broadcast((odds, rare))
            inside, stuffed = _presence(split, lambda b: shares(b, *model.value) > least_share)
            model.destroy()
        odds = np.where(every >= least_texts, word_odds(inside, every, stuffed, texts), np.float32(np.nan))
    return odds, rare


def _length_class(text: Column) -> Column:
    """Texts of under 150 characters, under 300, under 1,000, and longer ones, whose blocks compress alike."""
    n = F.length(text)
    return F.when(n < LEAST_BLOCK, -1).when(n < 300, 0).when(n < 1000, 1).otherwise(2)


def norms(measured: DataFrame) -> DataFrame:
    """``(lang, size, mid, spread)``: median and median deviation of the ratio by language and length, from a
    histogram of the ratios, so that each language is a bounded number of rows whatever its texts."""
    h = measured.filter("ratio is not null").groupBy("lang", "size", F.round("ratio", 3).alias("r")).count()
    mid = h.groupBy("lang", "size").agg(F.percentile("r", F.lit(0.5), F.col("count")).alias("mid"))
    far = h.alias("h").join(mid.alias("m"), F.expr("h.lang = m.lang and h.size = m.size"))
    far = far.select("h.lang", "h.size", "m.mid", F.abs(F.col("h.r") - F.col("m.mid")).alias("d"), "h.count")
    return far.groupBy("lang", "size").agg(F.first("mid").alias("mid"), F.greatest(F.percentile("d", F.lit(0.5), F.col("count")), F.lit(0.01)).alias("spread"))


def score_stuffing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = 4,
                   least_share: float = 0.4, extreme: float = 4.5, few_ends: float = 0.2, sole_extreme: float = 9.0,
                   sole_ends: float = 0.02) -> DataFrame:
    """``(id, ratio, ends, deviation, by_compression, share, stuffed)`` of every text that isn't blank; by_compression:
    what compression and sentence ends say without the word model, a seed.

    least_share: share of stuffed characters, as the model sees it, from which a text is reported; it stands for half
    of the true ones, as the model takes segments whose keywords are ordinary words as well for sentences. extreme,
    few_ends: a seed's deviation in units of its norm's spread, and its sentence ends per word at most. sole_extreme,
    sole_ends: the same, for a text reported without regard to its share.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "p8")
    lang = F.coalesce(F.col(lang_col), F.lit("none"))
    base = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"\S"))
    # Short texts are few in most languages and compress alike in all, so they have one norm.
    size = _length_class(F.col("text"))
    base = base.select("id", F.when(size < 0, "short").otherwise(F.col("lang")).alias("lang"), size.alias("size"), "text")
    kind = base.schema["id"].dataType.simpleString()
    split = scratch.cut(base.mapInArrow(_measured, f"id {kind}, lang string, size int, ratio double, ends double, {SPLIT}"), "split")
    norm = scratch.cut(norms(split).coalesce(1), "norms")
    split = split.join(small_side(norm), ["lang", "size"], "left").withColumn("deviation", (F.col("mid") - F.col("ratio")) / F.col("spread"))
    over = lambda far, ends: F.coalesce((F.col("deviation") > far) & (F.col("ends") <= ends), F.lit(False))
    split = split.withColumn("seed", over(extreme, few_ends))

    model = spark.sparkContext.broadcast(fit_words(split.select("seed", "chars", "sure", "counts", "words", "others"), rounds, least_share))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("id", "ratio", "ends", "deviation", "sole", "seed")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(shares(batch, *model.value))], names=["id", "ratio", "ends", "deviation", "sole", "seed", "share"])

    scored = split.withColumn("sole", over(sole_extreme, sole_ends)).select("id", "ratio", "ends", "deviation", "sole", "seed", "chars", "sure", "counts", "words")
    scored = scored.mapInArrow(share, f"id {kind}, ratio double, ends double, deviation double, sole boolean, seed boolean, share double")
    return scored.select("id", "ratio", "ends", "deviation", F.col("seed").alias("by_compression"), "share", ((F.col("share") > least_share) | F.col("sole")).alias("stuffed"))


def stuffed_pages(docs: DataFrame, **params) -> DataFrame:
    """``(doc_id)`` of the stuffed documents, each once."""
    return score_stuffing(docs, **params).filter("stuffed").select(F.col("id").alias("doc_id")).distinct()
