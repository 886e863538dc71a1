"""Answers to questions in a common form, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the answer form: punctuation in the order it is looked at, number words, articles, contractions.
PUNCTUATION = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've",
    "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've",
    "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're",
    "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've",
    "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd",
    "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's",
    "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all",
    "yall'll": "y'all'll", "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
#: Periods taken out of one answer, at most.
PERIODS = 32


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in entries.items() for v in pair])


def answer_form(text: Column) -> Column:
    """Lower case without punctuation, articles and periods before no digit; number words as digits, contractions with apostrophe.

    A punctuation mark goes where the text has it beside a space anywhere (or a comma between digits), else it becomes a space; commas and question
    marks go before that. A null stays null, an empty text empty."""
    start = F.lower(text)
    for old, new in ((",", ""), ("?", ""), ("'s", " 's"), ("\n", " "), ("\t", " ")):
        start = F.replace(start, F.lit(old), F.lit(new))
    start = F.regexp_replace(start, r"(?U)^\s+|\s+$", "")
    out, digits = start, start.rlike(r"\d,+\d")
    for mark in PUNCTUATION:
        beside = F.contains(start, F.lit(mark + " ")) | F.contains(start, F.lit(" " + mark)) | digits
        out = F.replace(out, F.lit(mark), F.when(beside, "").otherwise(" "))
    out = F.array_join(F.split(out, r"\.(?!\p{Nd})", PERIODS + 1), "")
    numbers, contractions = _table(NUMBERS), _table(CONTRACTIONS)
    words = F.transform(F.filter(F.split(out, r"(?U)\s+"), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(contractions, w), w)), " ")
