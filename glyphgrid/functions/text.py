"""Text scalars as column expressions; Unicode normalisation is the one Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else v.casefold())


def normalise(text: Column) -> Column:
    """NFKC, white space runs as one space, stripped."""
    return F.trim(F.regexp_replace(_nfkc(text), r"(?U)\s+", " "))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def safe_stem(path: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen only; 'sample' if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(file_stem(path), r"[^A-Za-z0-9._-]", "_"), r"^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("sample"))


def ned(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def pair_reward(truth: Column, guess: Column) -> Column:
    return F.greatest(1 - F.levenshtein(truth, guess) / F.greatest(F.length(truth), F.lit(1)), F.lit(0.0))


def anls(truth: Column, guess: Column, cut: float = 0.5) -> Column:
    a, b = F.lower(F.trim(truth)), F.lower(F.trim(guess))
    value = ned(a, b)
    return F.when(value < cut, 0.0).otherwise(value)


def letters_and_digits(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def printable_and_short(text: Column, most: int = 25) -> Column:
    return text.rlike(r"^[\x20-\x7E]{0," + str(most) + "}$")


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 13, F.concat(F.substring(name, 1, 11), F.lit(".."))).otherwise(name)


def with_article(name: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(name, 1, 1)).isin(*"aeiou"), F.lit("an ")).otherwise(F.lit("a ")), name)


def clean_name(name: Column) -> Column:
    return F.lower(F.replace(F.replace(name, F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" or ")))


def yes_or_no(answer: Column) -> Column:
    """'no' if the first sentence holds the token No, not or no, else 'yes'."""
    first = F.replace(F.split(answer, r"\.")[0], F.lit(","), F.lit(""))
    return F.when(F.arrays_overlap(F.split(first, " "), F.array(*map(F.lit, ("No", "not", "no")))), "no").otherwise("yes")


def choice_letter(answer: Column, options: str = "ABCDE") -> Column:
    """The letter itself, a leading 'A. ', or a single 'The answer is A.'; else 'FAILED'."""
    stated = F.regexp_extract_all(answer, F.lit(r"The answer is ([A-Z])\."), F.lit(1))
    return F.when(answer.isin(*options), answer).when(answer.rlike(rf"^[{options}]\. "), F.substring(answer, 1, 1)).when(F.size(stated) == 1, stated[0]).otherwise("FAILED")


def score_pair(review: Column) -> Column:
    """Two numbers from the first line, or [-1, -1]."""
    parts = F.split(F.trim(F.replace(F.split(review, "\n")[0], F.lit(","), F.lit(" "))), " ")
    two = F.transform(parts, lambda x: F.expr("1") * x.try_cast("double"))
    return F.when((F.size(parts) == 2) & F.forall(two, lambda x: x.isNotNull()), two).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def decode_codes(codes: Column, end: int = 94) -> Column:
    """Text of printable-ASCII codes (0 is the space) up to the end code."""
    stop = F.array_position(codes, F.lit(end))
    kept = F.when(stop > 0, F.slice(codes, 1, (stop - 1).cast("int"))).otherwise(codes)
    return F.array_join(F.transform(F.filter(kept, lambda c: (c >= 0) & (c < 95)), lambda c: F.char(c + 32)), "")


def encode_codes(text: Column, size: int = 25, end: int = 94, pad: int = 95) -> Column:
    codes = F.transform(F.split(F.substring(text, 1, size), ""), lambda c: F.ascii(c) - 32)
    codes = F.filter(codes, lambda c: (c >= 0) & (c < 95))
    return F.slice(F.concat(codes, F.array(F.lit(end)), F.array_repeat(F.lit(pad), size)), 1, size)


def ctc_decode(codes: Column, blank: int = 0) -> Column:
    """Repeats and blanks dropped."""
    return F.filter(F.transform(codes, lambda c, i: F.when((c == blank) | ((i > 0) & (F.get(codes, i - 1) == c)), F.lit(-1)).otherwise(c)), lambda c: c >= 0)


def consensus_score(answers: Column, answer: Column) -> Column:
    """Mean over leave-one-out of min(1, matches / 3) for an answer given by c of n annotators."""
    n = F.size(answers)
    c = F.size(F.filter(answers, lambda a: a == answer))
    return (c * F.least(F.lit(1.0), (c - 1) / 3) + (n - c) * F.least(F.lit(1.0), c / 3)) / n


def image_key(path: Column) -> Column:
    """Without a leading train/ and the extension."""
    return F.regexp_replace(F.regexp_replace(path, "^train/", ""), r"(?<=.)\.[^./]*$", "")


def first_given(*texts: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def prompt(texts: Column, most: int = 8) -> Column:
    """The first non-blank texts, quoted, joined by commas."""
    kept = F.slice(F.filter(texts, lambda t: F.trim(t) != ""), 1, most)
    return F.array_join(F.transform(kept, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")


def chunk_number(name: Column) -> Column:
    """n of chunk_n, null for any other name."""
    return F.regexp_extract(F.when(name.rlike("^chunk_[0-9]+$"), name), "([0-9]+)$", 1).cast("long")


def without_lines(text: Column, n: int) -> Column:
    """Without the first n lines."""
    return F.regexp_replace(text, "^(?:[^\n]*\n){" + str(n) + "}", "")


def same_but_edges(truth: Column, guess: Column, specials: str) -> Column:
    """Equal, or equal once the truth's first, last or both characters go, where these are specials."""
    n = F.length(truth)
    special = lambda c: (c != "") & F.contains(F.lit(specials), c)
    head, tail = special(F.substring(truth, 1, 1)), special(F.right(truth, F.lit(1)))
    cut = lambda start, less: F.substr(truth, F.lit(start), F.greatest(n - less, F.lit(0)))
    return (truth == guess) | (head & (cut(2, 1) == guess)) | (tail & (cut(1, 1) == guess)) | (head & tail & (cut(2, 2) == guess))


def character_f(truth: Column, guess: Column, epsilon: float = 1e-5) -> Column:
    """F score of the sets of characters."""
    a, b = F.array_distinct(F.split(truth, "")), F.array_distinct(F.split(guess, ""))
    both = F.size(F.array_intersect(a, b))
    p, r = both / (F.size(b) + epsilon), both / (F.size(a) + epsilon)
    return 2 * p * r / (p + r + epsilon)


def confidence(scores: Column) -> Column:
    """Product of the characters' scores, 1 for none."""
    return F.aggregate(scores, F.lit(1.0), lambda p, s: p * s)


def until_blank_option(options: Column) -> Column:
    """Options before the first that is null, nan or none in any case."""
    bad = F.transform(options, lambda o: F.lower(F.coalesce(o, F.lit("none"))).isin("nan", "none"))
    at = F.array_position(bad, F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(options, 1, at - 1)).otherwise(options)


#: Fixed values of the word-spotting rules: separators, and letters that count.
SEPARATORS, LETTERS, NOT_LETTERS = r"['!?.:,*\"()·\[\]/]", r"a-zA-ZÀ-ƿǄ-ɿΆ-Ͽ-", r"[×÷]"


def in_dictionary(word: Column, least: int = 3) -> Column:
    """One run of letters, long enough, once a final 's, outer hyphens and outer separators go."""
    own = F.regexp_replace(F.regexp_replace(word, "'[sS]$", ""), "^-+|-+$", "")
    own = F.trim(F.regexp_replace(own, SEPARATORS, " "))
    return own.rlike("^[" + LETTERS + "]{" + str(least) + ",}$") & ~own.rlike(NOT_LETTERS)


def weighted_distance(alphabet: str):
    """A function of word, other word and an array of each position's scores over the alphabet: edit distance by the confidence in the word's characters.

    Deleting costs the character's score, inserting the mean of its and the next one's, replacing 1 - 5 * score of the new / score of the old, not below 0."""

    at = {c: k for k, c in enumerate(alphabet)}

    def score(row, c: str) -> float:
        return max(row[at[c.upper()]], row[at[c.lower()]])

    def one(word: str, other: str, rows) -> float:
        own = [score(rows[j], c) for j, c in enumerate(word)]
        insert = [(s + own[j + 1]) / 2 if j + 1 < len(own) else s for j, s in enumerate(own)]
        line = [float(j) for j in range(len(word) + 1)]
        for i, c in enumerate(other, 1):
            last, line = line, [float(i)]
            for j, w in enumerate(word):
                swap = 0.0 if w == c else max(1 - 5 * score(rows[j], c) / own[j], 0.0)
                line.append(min(last[j + 1] + insert[j], line[j] + own[j], last[j] + swap))
        return line[-1]

    @pandas_udf(DoubleType())
    def distance(word: pd.Series, other: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or s is None else one(a, b, s) for a, b, s in zip(word, other, scores, strict=True)], dtype="float64")

    return distance


def prompt_question(prompt: Column) -> Column:
    """The question of a prompt in one of three layouts, in lower case; another layout raises."""
    lines = F.split(prompt, "\n")
    marked = F.regexp_extract(prompt, r"(?s)Question: (.*?) Short answer:", 1)
    out = F.when(prompt.startswith("OCR tokens: "), marked)
    out = out.when(prompt.contains("Reference OCR token: ") & (F.size(lines) == 3), F.when(prompt.startswith("Reference OCR token:"), lines[1]).otherwise(lines[0]))
    return F.lower(out.when(F.size(lines) == 2, lines[0]).otherwise(F.raise_error(F.lit("prompt of an unknown layout")).cast("string")))


def caption_form(caption: Column, most: int = 50) -> Column:
    """Lower case, punctuation as spaces, runs of white space as one space, ``most`` words."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(caption), r"[.!\"()*#:;~]", " "), r"\s{2,}", " ")
    words = F.split(F.regexp_replace(F.regexp_replace(spaced, r"\n+\z", ""), r"^ +| +\z", ""), " ")
    return F.array_join(F.slice(words, 1, most), " ")


def question_form(question: Column, most: int = 50) -> Column:
    """Lower case, without punctuation and spaces at the end, ``most`` words."""
    words = F.split(F.regexp_replace(F.regexp_replace(F.lower(question), r"[.!\"()*#:;~]", ""), r" +\z", ""), " ")
    return F.array_join(F.slice(words, 1, most), " ")


def turned_left(options: Column) -> Column:
    """The array with its first item last."""
    return F.concat(F.slice(options, 2, F.greatest(F.size(options), F.lit(1))), F.slice(options, 1, 1))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " "))
