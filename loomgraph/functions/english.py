"""English stems by the published Porter2 algorithm, and the stop words that go with it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import tokens

#: The stop words of the English text-search configuration.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
#: Fixed values of the algorithm: whole words with stems of their own, and words left alone after the first step.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes of steps 2 and 3 with what replaces them in R1, and those of step 4, removed in R2.
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")


def _after(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _longest(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


@lru_cache(maxsize=1 << 16)
def english_stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _after(w, 0)
    r2 = _after(w, r1)
    # Step 1a: plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    # Step 1b: past forms.
    if end := _longest(w, ("eedly", "eed")):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif (end := _longest(w, ("ingly", "edly", "ing", "ed"))) and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    # Step 1c: a final y.
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Steps 2 to 4: endings in the regions.
    if (end := _longest(w, STEP_2)) and len(w) - len(end) >= r1:
        head = w[: -len(end)]
        if end == "li":
            w = head if head[-1:] in tuple("cdeghkmnrt") else w
        elif end == "ogi":
            w = head + "og" if head.endswith("l") else w
        else:
            w = head + STEP_2[end]
    if (end := _longest(w, STEP_3)) and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[: -len(end)] + STEP_3[end]
    if (end := _longest(w, STEP_4)) and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    # Step 5: a final e or l.
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stems of arrays of words; of a batch, each word is stemmed once."""
    for words in batches:
        words = words.fill_null([])
        flat = pc.dictionary_encode(words.flatten())
        stems = pa.array([english_stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        yield pa.ListArray.from_arrays(ends, stems.take(flat.indices))


def english_stems(text: Column) -> Column:
    """English stems of the tokens that aren't stop words; none for null."""
    return F.arrow_udf("array<string>")(_stemmed)(F.filter(tokens(text), lambda t: ~t.isin(*ENGLISH_STOP_WORDS)))
