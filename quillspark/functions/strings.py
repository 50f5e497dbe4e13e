"""String functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"
#: Fixed value: the characters that count as punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def word_bigrams(word: Column) -> Column:
    """The bigrams of a word with a pilcrow at both ends: one more than it has characters."""
    framed = F.concat(F.lit("¶"), word, F.lit("¶"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(framed, i, F.lit(2)))


def multiset_jaccard(occurrences: Column, query_bigrams: Column, word_bigrams_: Column) -> Column:
    """Shared occurrences over the rest of both bigram counts; null where the denominator is 0. It can exceed 1, as overlaps count each pairing."""
    return F.try_divide(occurrences, query_bigrams + word_bigrams_ - occurrences)


def preprocess(words: Column, stop_words: list[str], minimum_length: int = 1, lower_case: bool = True, punctuation_removal: bool = True) -> Column:
    """Filters a word list: stop words (any case), then words that are a substring of the punctuation, then words of at most
    minimum_length characters; then lower case."""
    out = F.filter(words, lambda w: ~F.lower(w).isin([s.lower() for s in stop_words])) if stop_words else words
    if punctuation_removal:
        out = F.filter(out, lambda w: ~F.lit(PUNCTUATION).contains(w))
    out = F.filter(out, lambda w: F.length(w) > minimum_length)
    return F.transform(out, F.lower) if lower_case else out


def highlight(text: Column, starts: Column, ends: Column, before: str = '<mark style="background-color: #FFFF00">', after: str = "</mark>") -> Column:
    """Marks [start, end) for each pair of offsets (0-based). Repeated or overlapping spans are marked once, from the left."""
    spans = F.array_sort(F.array_distinct(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        s, e = span["s"].cast("int"), span["e"].cast("int")
        marked = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), F.lit(before), F.substring(text, s + 1, e - s), F.lit(after))
        return F.when(s >= acc["at"], F.struct(e.alias("at"), marked.alias("out"))).otherwise(acc)

    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def first_of_list_literal(literal: Column) -> Column:
    """First item of a list that is written like ['a', "it's"]: what lies between its first quotes, escapes undone; never evaluated. Null
    if there is none."""
    item = {q: rf"^\s*\[\s*{q}((?:[^{q}\\]|\\.)*){q}\s*[,\]]" for q in ("'", '"')}
    quoted = F.coalesce(*(F.when(F.rlike(literal, F.lit(p)), F.regexp_extract(literal, p, 1)) for p in item.values()))
    return F.regexp_replace(quoted, r"\\(.)", "$1")


def id_from_url(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def url_from_id(paper_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), paper_id)


def number_with_commas(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("int")
