"""Problem 3: mapping free-entered phrases to a canonical vocabulary.

Method: token-level repair. Each distinct token of the phrases is joined to the tokens of the vocabulary by edit
distance; the join's keys are the tokens with one or two characters deleted, their consonants, and their
beginnings, so no token meets the whole vocabulary. Repaired tokens are combined with soft TF-IDF, in which each
token counts by its weight and its similarity, to rank complete entries. An entry is accepted if every content word
of its label or of one of its aliases was found in the phrase; words in between and around don't count.

A repair is dropped if the token, in most phrases that have it, stands beside no other word of an entry: it is
then a word of its own that only looks like one of the vocabulary.

Words may be torn apart anywhere: every run of neighbouring tokens that is not longer than the longest vocabulary token
and two edits is a token as well, and may have one edit more.

Only distinct phrases and tokens are worked on; the result is joined to the rows at the end.

Defined results: null, empty and blank phrases are left out; a phrase repeated in a record counts once; phrases that
no entry covers, or several equally well, are ``unmatched``; with an empty vocabulary all are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.session import Scratch

UNMATCHED = "unmatched"
# Marks a token that was joined from neighbours.
RUN = "+"
ROWS_A_TASK = 20_000
# Letters of other alphabets that look like Latin ones, and digits written for letters.
LOOKALIKES = str.maketrans("асеорхуіјѕԁкмтвнгαορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aceopxyijsdkmtbhraopviktABEZHIKMNOPTYXABEKMHOPCTX")
DIGITS = str.maketrans("0134578", "oleastb")
SMALL_WORDS = {"of", "the", "a", "an"}


def tokens_of(phrase: str) -> list[str]:
    """Lower-case tokens, with accents, look-alike letters, digits within words and joined capitals undone."""
    s = unicodedata.normalize("NFKD", phrase)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LOOKALIKES)
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", s).lower()
    out = []
    for t in re.findall(r"[^\W_]+", s):
        if re.search(r"\d", t) and re.search(r"[a-z]", t) and not re.fullmatch(r"\d+[a-z]", t):
            t = t.translate(DIGITS)
        out.append(t)
    return out


def _deleted(t: Column) -> Column:
    """A text without each of its characters."""
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))


def _twice_deleted(t: Column) -> Column:
    """A text of two characters at least without each two of its characters."""

    def after(i: Column) -> Column:
        head, rest = F.left(t, i - 1), F.substr(t, i + 1)
        return F.transform(F.sequence(F.lit(1), F.length(t) - i), lambda j: F.concat(head, F.left(rest, j - 1), F.substr(rest, j + 1)))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(t) - 1), after))


def _swapped(t: Column) -> Column:
    """A text with each two neighbouring characters swapped."""
    at = lambda i, n: F.substr(t, i, F.lit(n))
    swaps = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.concat(F.left(t, i - 1), at(i + 1, 1), at(i, 1), F.substr(t, i + 2)))
    return F.when(F.length(t) > 1, swaps).otherwise(F.array().cast("array<string>"))


def edits(a: Column, b: Column) -> Column:
    """Insertions, deletions, replacements and swaps of neighbours that turn a into b, where they are two at most; a
    greater number or null else."""
    plain = F.levenshtein(a, b, 4)
    swaps = _swapped(a)
    one = F.array_contains(swaps, b)
    two = F.exists(swaps, lambda x: F.levenshtein(x, b, 1) >= 0) | F.arrays_overlap(swaps, _swapped(b))
    return F.when(plain.between(0, 1), plain).when((plain >= 2) & one, 1).when((plain >= 3) & two, 2).when(plain >= 0, plain)


def _consonants(t: Column) -> Column:
    return F.concat(F.left(t, F.lit(1)), F.regexp_replace(F.substr(t, F.lit(2)), "[aeiou]", ""))


def allowed_edits(n: Column) -> Column:
    """Edits that a word of n letters may have."""
    return F.when(n <= 4, 0).when(n == 5, 1).otherwise(2)


def _plain(token: Column) -> Column:
    return F.ltrim(token, F.lit(RUN))


def keys_of(token: Column, known: bool, longest: int) -> Column:
    """Hashes under which a token and a vocabulary token meet: the token, with one or two characters deleted, its
    consonants, and its beginnings. known: the token is one of the vocabulary.

    A token more than two characters longer than the longest of the vocabulary is no edit of any, so it has no
    deletions; a run has no consonants and beginnings, and one deletion at most.
    """
    t, none = _plain(token), F.array().cast("array<string>")
    n = F.length(t)
    one = F.when((n > 3) & (n <= longest + 2), _deleted(t)).otherwise(none)
    two = F.when((n > 4) & (n <= longest + 2) & ~token.startswith(RUN), _twice_deleted(t)).otherwise(none)
    c = _consonants(t)
    begins = F.when(n > 4, F.transform(F.sequence(F.lit(4), n - 1), lambda i: F.left(t, i))).otherwise(none) if known else F.when(n >= 4, F.array(t)).otherwise(none)
    tag = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    loose = F.concat(F.when(F.length(c) >= 3, F.array(F.concat(F.lit("c"), c))).otherwise(none), tag("p", begins))
    every = F.concat(tag("=", F.concat(F.array(t), one, two)), F.when(token.startswith(RUN), none).otherwise(loose))
    return F.transform(every, lambda x: F.xxhash64(x))


def similarity(token: Column, known: Column) -> Column:
    """1 for equal tokens, less for each edit; 0 for what is no writing of the vocabulary token. A run of tokens may
    have one edit, but is no plural, abbreviation or beginning."""
    t, word = _plain(token), ~token.startswith(RUN)
    n, d = F.length(known), edits(t, known)
    return (
        F.when(t == known, 1.0)
        .when(word & (n.between(3, 4)) & t.isin(F.concat(known, F.lit("s")), F.concat(known, F.lit("es"))), 0.95)
        .when(n <= 4, 0.0)
        .when((d <= F.when(word, allowed_edits(n)).otherwise(1)) & (d < F.length(t)), 1.0 - d / n)
        .when(~word, 0.0)
        .when(t == F.concat(known, F.lit("es")), 0.95)
        .when((_consonants(t) == _consonants(known)) & (F.length(_consonants(t)) >= 3), 0.8)
        .when((F.length(t) >= 4) & known.startswith(t), 0.75)
        .otherwise(0.0)
    )


def with_runs(tokens: list[str], longest: int) -> list[str]:
    """Tokens without small words; all of them joined, for what was run together with something between; and, marked
    by :data:`RUN`, each run of neighbours that is no longer than any vocabulary token and two edits, for what was
    torn apart."""
    out = [t for t in tokens if t not in SMALL_WORDS] + ["".join(tokens)]
    for i in range(len(tokens)):
        run = tokens[i]
        for t in tokens[i + 1 :]:
            run += t
            if len(run) > longest + 2:
                break
            out.append(RUN + run)
    return list(dict.fromkeys(out))


def _tokens(longest: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(phrases: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in phrases:
            yield batch.map(lambda p: with_runs(tokens_of(p), longest))

    return tokens


@F.pandas_udf(T.ArrayType(T.StringType()))
def _form_tokens(forms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in forms:
        yield batch.map(lambda f: [t for t in tokens_of(f) if t not in SMALL_WORDS])


def vocabulary_forms(vocabulary: DataFrame) -> DataFrame:
    """``(cid, form, known, weight, parts)``: the content tokens of every label and alias, and each form joined to
    one token; weight: the token's inverse document frequency over the forms; parts: tokens of the form."""
    forms = vocabulary.select("cid", F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    forms = forms.filter("cid is not null and form is not null").distinct().withColumn("t", _form_tokens("form")).filter(F.size("t") > 0)
    apart = forms.select("cid", "form", F.explode(F.array_distinct("t")).alias("known"), F.size(F.array_distinct("t")).alias("parts"))
    joined = forms.filter(F.size("t") > 1).select("cid", F.concat(F.lit("+"), "form").alias("form"), F.array_join("t", "").alias("known"), F.lit(1).alias("parts"))
    whole = forms.filter(F.size("t") > 1).select("cid", F.concat(F.lit("+"), "form").alias("form"), F.regexp_replace(F.lower("form"), r"[^\p{L}\p{N}]+", "").alias("known"), F.lit(1).alias("parts"))
    every = apart.unionByName(joined).unionByName(whole).distinct()
    # One row for the whole vocabulary.
    n = every.agg(F.countDistinct("form").alias("n"))
    df = every.groupBy("known").agg(F.countDistinct("form").alias("df")).join(F.broadcast(n)).select("known", F.log(F.lit(1.0) + F.col("n") / F.col("df")).alias("weight"))
    return every.join(df, "known")


def _counted(df: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    seen = Observation()
    out = scratch.cut(df.observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Much work for few bytes: partitions by count, as those by size would leave most cores idle."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_TASK))


def map_phrases(phrases: DataFrame, n: int, vocabulary: DataFrame, scratch: Scratch, own_word_share: float = 0.5) -> DataFrame:
    """``(phrase, cid)`` of the distinct ones of n phrases, ``unmatched`` where no entry stands out."""
    forms = scratch.cut(vocabulary_forms(vocabulary), "forms")
    longest = forms.agg(F.max(F.length("known")).alias("n")).first()["n"] or 0
    split = scratch.cut(_spread(phrases.select("phrase").distinct(), n).withColumn("tokens", _tokens(longest)("phrase")), "phrases")
    at = split.select("phrase", F.explode("tokens").alias("token"))
    tokens, n = _counted(at.groupBy("token").agg(F.count("*").alias("in_phrases")), scratch, "tokens")
    left = _spread(tokens, n).select("token", "in_phrases", F.explode(keys_of(F.col("token"), False, longest)).alias("k"))
    right = forms.select("known").distinct().select("known", F.explode(keys_of(F.col("known"), True, longest)).alias("k"))
    near = left.join(right, "k").select("token", "in_phrases", "known").distinct()
    near = near.withColumn("sim", similarity(F.col("token"), F.col("known"))).filter("sim > 0")
    # A token that is in the vocabulary stands for itself only.
    same = _plain(F.col("token")) == F.col("known")
    exact = F.max(F.when(same, 1).otherwise(0)).over(Window.partitionBy("token"))
    near = scratch.cut(near.withColumn("exact", exact).filter((F.col("exact") == 0) | same).drop("exact"), "repairs")

    hits = at.join(near, "token").join(forms, "known").groupBy("phrase", "cid", "form", "parts", "known", "weight").agg(F.max(F.struct("sim", "token", "in_phrases")).alias("b"))
    by_form = Window.partitionBy("phrase", "cid", "form")
    hits = scratch.cut(hits.withColumn("found", F.count("*").over(by_form)).filter("found = parts").select(
        "phrase", "cid", "form", "known", "weight", "parts", "b.*"), "hits")
    # How often a repaired token completes an entry, of all phrases that have it.
    apt = hits.filter("parts > 1 and token <> known").groupBy("token", "known").agg((F.countDistinct("phrase") / F.max("in_phrases")).alias("apt"))
    hits = hits.join(apt, ["token", "known"], "left").filter(F.coalesce(F.col("apt") >= own_word_share, F.lit(True)))
    scored = hits.groupBy("phrase", "cid", "form", "parts").agg(
        F.count("*").alias("n"), (F.sum(F.col("sim") * F.col("weight") ** 2) / F.sum(F.col("weight") ** 2)).alias("soft"), F.sum("weight").alias("mass"))
    scored = scored.filter("n = parts").groupBy("phrase", "cid").agg(F.max(F.struct("soft", "mass")).alias("s"))
    top = scored.groupBy("phrase").agg(F.max(F.struct(F.round("s.soft", 6).alias("soft"), F.round("s.mass", 6).alias("mass"))).alias("m"))
    best = scored.join(top, "phrase").filter((F.round("s.soft", 6) == F.col("m.soft")) & (F.round("s.mass", 6) == F.col("m.mass")))
    best = best.groupBy("phrase").agg(F.min("cid").alias("cid"), F.count("*").alias("ties")).filter("ties = 1")
    return split.select("phrase").join(best.select("phrase", "cid"), "phrase", "left").select("phrase", F.coalesce("cid", F.lit(UNMATCHED)).alias("cid"))


def map_concepts(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(unit_id, concept_raw, cid)``: each distinct phrase of a unit with its entry or ``unmatched``."""
    scratch = Scratch(units.sparkSession, "p3")
    rows = units.select("unit_id", F.explode("metadata.concepts_raw").alias("concept_raw"))
    rows, n = _counted(rows.filter(F.col("concept_raw").rlike(r"(?U)\S") & F.col("unit_id").isNotNull()).distinct(), scratch, "rows")
    found = map_phrases(rows.select(F.col("concept_raw").alias("phrase")), n, vocabulary, scratch)
    return rows.join(found.withColumnRenamed("phrase", "concept_raw"), "concept_raw").select("unit_id", "concept_raw", "cid")


def unmatched_phrases(mapped: DataFrame) -> DataFrame:
    """``(concept_raw, units)`` of the phrases without entry, for a look at what the vocabulary lacks."""
    return mapped.filter(F.col("cid") == UNMATCHED).groupBy("concept_raw").agg(F.countDistinct("unit_id").alias("units"))
