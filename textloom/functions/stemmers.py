"""Porter, Lancaster and Spanish stemmers, written from the published algorithms.

They run over the distinct terms only: stems() takes a vocabulary in Arrow batches,
and counts are added up by stem afterwards.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import ship

# ---- Porter (1980)

#: The suffix pairs of steps 2 and 3 and the suffixes of step 4.
STEP2 = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP3 = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


def porter(word: str) -> str:
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                stem = word[: -len(end)]
                if "v" in _shape(stem):
                    if stem.endswith(("at", "bl", "iz")):
                        stem += "e"
                    elif _double(stem) and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    elif _measure(stem) == 1 and _short_end(stem):
                        stem += "e"
                    word = stem
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for pairs in (STEP2, STEP3):
        end = max((e for e in pairs if word.endswith(e)), key=len, default=None)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + pairs[end]
    end = max((e for e in STEP4 if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# ---- Lancaster (Paice 1990)

#: Fixed values, the published rules: the ending backwards, * for words not yet changed,
#: letters to remove, letters to add, then > to go on or . to stop.
RULES = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. "
    "ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. "
    "lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. "
    "re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> "
    "tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. "
    "ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()


@cache
def _rules() -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    """Rules by last letter: ending, intact only, letters off, letters on, go on."""
    out: dict[str, list] = {}
    for rule in RULES:
        end, intact, off, on, then = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", rule).groups()
        out.setdefault(end[0], []).append((end[::-1], bool(intact), int(off), on, then == ">"))
    return out


def lancaster(word: str) -> str:
    intact, rules = word, _rules()
    while True:
        for end, only_intact, off, on, more in rules.get(word[-1:], ()):
            if not word.endswith(end) or (only_intact and word != intact):
                continue
            new = word[: len(word) - off] + on
            rest = word[: len(word) - off]
            # what stays needs two letters if it begins with a vowel, else three and a vowel
            if (len(rest) >= 2 if rest[:1] in ("a", "e", "i", "o", "u") else len(rest) >= 3 and any(c in "aeiouy" for c in rest)):
                break
        else:
            return word
        word = new
        if not more:
            return word


# ---- Spanish (Snowball)

VOWELS = "aeiouáéíóúü"
PLAIN = str.maketrans("áéíóú", "aeiou")
#: The endings of the algorithm's steps.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS = "iéndo ándo ár ér ír".split()
GERUNDS_PLAIN = "ando iendo ar er ir".split()
ENDINGS_1 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ENDINGS_2 = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
Y_ENDINGS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
VERB_EN = "en es éis emos".split()
VERB_ENDINGS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen "
    "iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis "
    "isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _region(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _longest(word: str, start: int, ends) -> str:
    return max((e for e in ends if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def spanish(word: str) -> str:
    rv = _rv(word)
    r1 = _region(word, 0)
    r2 = _region(word, r1)
    # pronouns after a gerund or infinitive
    if pronoun := _longest(word, rv, PRONOUNS):
        stem = word[: -len(pronoun)]
        if before := _longest(stem, rv, GERUNDS):
            word = stem[: -len(before)] + before.translate(PLAIN)
        elif _longest(stem, rv, GERUNDS_PLAIN) or (stem.endswith("uyendo") and _longest(stem, rv, ["yendo"])):
            word = stem
    before = word
    word = _suffix(word, r1, r2)
    if word == before:
        word = _verb(word, rv)
    # what is left over
    if end := _longest(word, rv, ["os", "a", "o", "á", "í", "ó"]):
        word = word[: -len(end)]
    elif end := _longest(word, rv, ["e", "é"]):
        word = word[:-1]
        if word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(PLAIN)


def _suffix(word: str, r1: int, r2: int) -> str:
    all_ends = [*ENDINGS_1, *ENDINGS_2, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    end = _longest(word, 0, all_ends)
    stem = word[: len(word) - len(end)]
    in_r2 = len(stem) >= r2

    def drop(w: str, *ends: str) -> str:
        found = _longest(w, r2, ends)
        return w[: -len(found)] if found else w

    if not end:
        return word
    if end == "amente":
        if len(stem) < r1:
            return word
        if _longest(stem, r2, ["iv"]):
            return drop(stem[:-2], "at")
        return drop(stem, "os", "ic", "ad")
    if not in_r2:
        return word
    if end in ENDINGS_1:
        return stem
    if end in ENDINGS_2:
        return drop(stem, "ic")
    if end in ("logía", "logías"):
        return stem + "log"
    if end in ("ución", "uciones"):
        return stem + "u"
    if end in ("encia", "encias"):
        return stem + "ente"
    if end == "mente":
        return drop(stem, "ante", "able", "ible")
    if end in ("idad", "idades"):
        return drop(stem, "abil", "ic", "iv")
    return drop(stem, "at")


def _verb(word: str, rv: int) -> str:
    end = _longest(word, rv, Y_ENDINGS)
    if end and word[: -len(end)].endswith("u"):
        return word[: -len(end)]
    end = _longest(word, rv, [*VERB_EN, *VERB_ENDINGS])
    if not end:
        return word
    word = word[: -len(end)]
    return word[:-1] if end in VERB_EN and word.endswith("gu") else word


STEMMERS = {"porter": porter, "lancaster": lancaster, "spanish": spanish}


def stems(terms: DataFrame, name: str) -> DataFrame:
    """The distinct terms (column term) with their stem."""
    ship(terms.sparkSession)

    def run(batches):
        stem = STEMMERS[name]
        for batch in batches:
            column = batch.column(0)
            yield pa.RecordBatch.from_arrays([column, pa.array([None if t is None else stem(t) for t in column.to_pylist()], pa.string())], ["term", "stem"])

    return terms.select("term").distinct().mapInArrow(run, "term string, stem string")


def stemmed(postings: DataFrame, name: str, binary_tf: bool = False) -> DataFrame:
    """doc_id, term (the stem) and tf; the counts of terms with one stem are added, or all are 1 with binary_tf."""
    joined = postings.join(stems(postings.select("term"), name), "term")
    tf = F.lit(1).cast("long") if binary_tf else F.sum("tf")
    return joined.groupBy("doc_id", F.col("stem").alias("term")).agg((F.max(F.lit(1).cast("long")) if binary_tf else tf).alias("tf"))
