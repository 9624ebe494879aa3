"""Personal information inside free text: found under its disguises and replaced by typed placeholders.

A chain of transducers rewrites the text into a plain form: look-alike letters of other scripts and wide digits become
ASCII, invisible characters vanish, digits that are spelled out become digits, and disguised at signs and dots become
signs.  Each keeps the offsets of what it rewrote.  Identifiers are detected in the plain form and their spans mapped
back to the source, whose other characters stay as they are.

Personal names need names to be known: given and family names are learned from the corpus itself, from the places
where a phrase announces a person.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import skew, storage

# Transducers ----------------------------------------------------------------------------------
#: Cyrillic and Greek letters and the Latin ones they look like (fixed values).
LOOKALIKES = str.maketrans("авеёкмнорстухісјѕԁԛԝһАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeekmhopctyxicjsdqwhABEKMHOPCTYXIJSaeikvoptuxABEZHIKMNOPTYX")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_WIDE = re.compile("[  -   　‐-―−！-～٠-٩۰-۹०-९①-⑨⁰-⁹₀-₉\U0001d400-\U0001d7ff]")
_MIXED = re.compile(r"(?=[^\W_]*[a-zA-Z0-9])(?=[^\W_]*[Ͱ-ϿЀ-ӿԀ-ԯ])[^\W_]+(?:[@._+-][^\W_]+)*")
_AT = re.compile(r"(?<=[\w.+-])\s*(?:[(\[{<]\s*(?:at|arobase|chiocciola|klammeraffe|ät|@)\s*[)\]}>]|&#64;|&commat;|%40|\s(?:AT|arobase|chiocciola|klammeraffe)\s|\s+@\s*|@\s+)\s*(?=[\w-]+\s*(?:\.|[(\[{]\s*(?:dot|punto|punkt|point|\.)))", re.I)
#: Entities of the signs and of the dot.
_ENTITY = re.compile(r"&(?:#0*64|#x0*40|commat|(#0*46|#x0*2e|period));", re.I)
#: Words after which a plain "at" before a host is no disguise (fixed values).
_NO_LOCAL = frozenset("is are was were be been am look looks looked arrive arrived meet met stay live lives lived work works available hosted found online visit site page website see seen it us here documentation docs more stop stopped start sold held and or of the".split())
_OTHER_SCRIPT = re.compile("[Ͱ-ϿЀ-ӿԀ-ԯ]")
#: What a text in small letters must hold for the patterns above and below to match; letters that only some foldings make equal lead straight to the patterns.
_AT_HINTS = ("&#64;", "&commat;", "%40", "arobase", "chiocciola", "klammeraffe")
_AT_SIGN, _AT_OPEN, _AT_PLAIN = re.compile(r"\s@|@\s|[(\[{<]@"), re.compile(r"[(\[{<]\s*(?:at|ät|@)"), re.compile(r"at\s+[\w-]+\s*[.(\[{]")
_DOT_HINTS = ("dot", "punto", "punkt", "point")
_DOT_OPEN, _FOLDS = re.compile(r"[(\[{]\s*\."), re.compile("[\u0131\u0130\u017f\u212a]")
_AT_WORD = re.compile(r"(?<=[\w+-])\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)+\b)", re.I)
_DOT = re.compile(r"(?<=\w)\s*[(\[{]\s*(?:dot|punto|punkt|point|\.)\s*[)\]}]\s*(?=\w)|(?<=\w)\s+(?:dot)\s+(?=\w)", re.I)
#: Spelled digits (fixed values) of English, French, German and Italian.
DIGIT_WORDS = {w: str(i) for i, ws in enumerate(["zero oh null zéro", "one eins un uno", "two zwei zwo deux due", "three drei trois tre", "four vier quatre quattro", "five fünf cinq cinque", "six sechs sei", "seven sieben sept sette", "eight acht huit otto", "nine neun neuf nove"]) for w in ws.split()}
_DIGIT_WORD_SET = frozenset(DIGIT_WORDS) | {"double", "triple"}
_SPELLED = re.compile(rf"(?<!\w)(?:double\s+|triple\s+)?(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})(?:[\s,.-]+(?:double\s+|triple\s+)?(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})){{5,}}(?!\w)", re.I)


def _spells(low: str) -> bool:
    """Whether four words in a row are digits: all but the first and last of six, to which other signs may cling."""
    said = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    if _DIGIT_WORD_SET.isdisjoint(said):
        return False
    run = 0
    for w in said:
        run = run + 1 if w in _DIGIT_WORD_SET else 0
        if run == 4:
            return True
    return False


def _digits(m: re.Match) -> str:
    out, times = "", 1
    for w in re.findall(r"[^\W\d_]+", m[0].replace("İ", "i").replace("ı", "i").casefold()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out, times = out + DIGIT_WORDS[w] * times, 1
    # Ten digits are said as a phone number; written so, they are read so.
    return re.sub(r"^(1?)(\d{3})(\d{3})(\d{4})$", lambda m: "-".join(filter(None, m.groups())), out)


def _plain_char(m: re.Match) -> str:
    c = m[0]
    if "‐" <= c <= "―" or c == "−":
        return "-"
    return unicodedata.normalize("NFKC", c) if not c.isdecimal() else str(unicodedata.decimal(c))


class Plain:
    """A text in plain form, with the way back: each rewriting keeps where it happened."""

    def __init__(self, text: str) -> None:
        self.text, self.steps = text, []
        if not text.isascii():
            self.rewrite(_INVISIBLE, lambda m: "")
            self.rewrite(_WIDE, _plain_char)
            if _OTHER_SCRIPT.search(self.text):
                self.rewrite(_MIXED, lambda m: m[0].translate(LOOKALIKES))
        # Plain substring tests first: few texts hold a disguise.
        low = self.text.lower()
        if "&" in low and _ENTITY.search(low):
            self.rewrite(_ENTITY, lambda m: "." if m[1] else "@")
            low = self.text.lower()
        odd = not low.isascii() and bool(_FOLDS.search(self.text))
        if odd or any(h in low for h in _AT_HINTS) or "@" in low and _AT_SIGN.search(low) or _AT_OPEN.search(low) or _AT_PLAIN.search(low):
            self.rewrite(_AT, self._sign)
        if odd or "dot" in low and "at" in low:
            self.rewrite(_AT_WORD, lambda m: "@")
        if "@" in self.text and (odd or any(h in low for h in _DOT_HINTS) or _DOT_OPEN.search(low)):
            self.rewrite(_DOT, lambda m: ".")
        if odd or _spells(low):
            self.rewrite(_SPELLED, _digits)

    def _sign(self, m: re.Match) -> str:
        """A sign, or a plain "at" as it is after a word that is no address's first part."""
        if m[0].strip() == "at" and (w := re.search(r"[\w.+-]+$", self.text[max(0, m.start() - 64) : m.start()])) and w[0].lower() in _NO_LOCAL:
            return m[0]
        return "@"

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], str]) -> None:
        out, at, length = [], 0, 0
        ends, shifts = [0], [(0, 0, 0)]  # from this plain position on: (source position, plain length rewritten, source length)
        for m in pattern.finditer(self.text):
            new = by(m)
            if new == m[0]:
                continue
            out += [self.text[at : m.start()], new]
            length += m.start() - at
            ends.append(length)
            shifts.append((m.start(), len(new), m.end() - m.start()))
            length += len(new)
            at = m.end()
        if len(ends) > 1:
            out.append(self.text[at:])
            self.text = "".join(out)
            self.steps.append((ends, shifts))

    def source(self, at: int, end: bool = False) -> int:
        """The source position of a plain position; of a span's end, the end of what was rewritten into its last character."""
        for ends, shifts in reversed(self.steps):
            k = bisect_right(ends, at - (1 if end and at else 0)) - 1
            start, plain, src = shifts[k]
            inside = at - ends[k]
            if inside < plain:
                at = start + src if end else start + min(inside, src) if plain == src else start
            else:
                at = start + src + inside - plain
        return at


# Detectors ------------------------------------------------------------------------------------
_EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%'-]*[\w+-])?@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-]*@)")
_LABEL = r"(?<!\w)(?:{})[^\w\n]{{0,4}}(?:(?:no|n[°º]|nr|num(?:ber|éro|ero)?|is)\b[^\w\n]{{0,3}})?"
_NOT_DIGIT = r"(?![\d]|[-.,/]\d)"
_BEFORE = r"(?<![\w.,/#-])"
_IDS = [
    (re.compile(_LABEL.format(r"SIN|NAS|social insurance(?: number)?|insurance number|numéro d['’]assurance sociale") + r"(\d{3}[ -]?\d{3}[ -]?\d{3})" + _NOT_DIGIT, re.I), 1),
    (re.compile(_BEFORE + r"(\d{3}-\d{2}-\d{4})" + _NOT_DIGIT), 1),
    (re.compile(_LABEL.format(r"SSN|social(?: security)?(?: number)?") + r"(\d{3}[ -]?\d{2}[ -]?\d{4})" + _NOT_DIGIT, re.I), 1),
    (re.compile(_BEFORE + r"([12][ .]?\d{2}[ .]?\d{2}[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}(?:[ .]?\d{2})?)" + _NOT_DIGIT), 1),
    (re.compile(_LABEL.format(r"IdNr|Id-?Nr|IDNR|Identifikationsnummer|Steuer-?(?:ID|nummer|Identifikationsnummer)|Steuernr|TIN") + r"(\d{2}[ /.]?\d{3}[ /.]?\d{3}[ /.]?\d{3})" + _NOT_DIGIT, re.I), 1),
    (re.compile(_LABEL.format(r"SV-?N(?:umme)?r|Sozialversicherungs(?:nummer|nr)|Rentenversicherungsnummer") + r"(\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3})" + _NOT_DIGIT, re.I), 1),
    (re.compile(r"(?<!\w)((?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"), 1),
]
_FISCAL = re.compile(r"(?<!\w)([A-Z]{3} ?[A-Z]{3} ?\d{2}[A-EHLMPRST]\d{2} ?[A-Z]\d{3}[A-Z])(?!\w)", re.I)
_PHONES = [
    re.compile(r"(?<![\w.+/-])\+\d{1,3}[ .\-/]?(?:\(0?\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){6,12}" + r"(?!\d)"),
    re.compile(_BEFORE + r"00(?:1|33|34|39|41|43|44|49)[ .\-/]?\d(?:[ .\-/]?\d){7,11}(?!\d)"),
    re.compile(r"(?<![\w.,/#-])(?:1[-. ])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])[2-9]\d{2}[-. ]\d{4}(?![\d-])"),
    re.compile(_BEFORE + r"0[1-9](?:[ .-]?\d{2}){4}(?![\d-]|[ .]\d{2}\b)"),
    re.compile(_BEFORE + r"07\d{3} ?\d{3} ?\d{3}(?![\d-])"),
    re.compile(r"(?<![\w.,/#-])(?:\(0\d{1,4}\) ?|0\d{1,4}[ /])\d{4,8}(?:[ -]\d{1,4})?(?![\d/-])"),
]
#: Six digits with little between them, which every phone and every number of _IDS but the Italian one holds; a number is looked for around them, labels included.
_RUN, _REACH_BACK, _REACH_ON = re.compile(r"\d(?:[ ().\-/]{0,3}\d){5,}"), 96, 48
#: What an Italian number ends with.
_FISCAL_END = re.compile(r"\d[A-Z]\d\d ?[A-Z]\d{3}[A-Z]", re.I)
#: What such numbers are called when they are no phones (fixed values).
_NO_PHONE = re.compile(r"(?:checksum|tracking|lsn|shelfmark|order|folio|isbn|issn|invoice|batch|code|total|c\$|€|£|\$|page)\W{0,3}$", re.I)
_UP = "A-ZÀ-ÖØ-Þ"
_CAP = rf"[{_UP}][\w'’-]*"
_ADDRESSES = [
    re.compile(rf"\d(?<![\w.,/-]\d)\d{{0,4}} ?(?:[A-Z](?![\w'’])|½)? ?(?:(?:North|South|East|West|[NSEW]\.?) )?{_CAP}(?: {_CAP}){{0,2}} (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Quay|Crescent|Cres|Drive|Dr|Close|Court|Ct|Way|Row|Terrace|Hill|Square|Sq|Place|Pl|Boulevard|Blvd|Parkway|Wharf|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|QUAY|CRESCENT|DRIVE|TERRACE)(?![\w'’])\.?"),
    re.compile(rf"\d(?<![\w./-]\d)\d{{0,3}}(?: ?(?:bis|ter|quater|[A-Z](?!\w)))?,? (?i:rue|avenue|av\.|chemin|quai|boulevard|bd|place|impasse|allée|ruelle|cours|passage|route|sentier|square|côte) (?:(?i:de la|de l['’]|des|du|de|d['’]|la|le|les|l['’]) ?)?{_CAP}"),
    re.compile(rf"(?<!\w)(?i:via|viale|vicolo|piazza|piazzale|corso|largo|calle|strada|borgo|salita|contrada|lungarno|vico) (?:(?i:della|del|dei|delle|degli|di|dell['’]|d['’]|san|santa) ?)?{_CAP}(?: {_CAP}){{0,2}}(?:,? n\.? ?|,? (?i:civico|numero) |, ?| )\d{{1,4}}(?: ?/ ?[A-Za-z]|[a-z])?(?![\w])"),
    re.compile(rf"(?<!\w)(?:(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte|Alter|Neue|Große|Kleine) )?{_CAP}(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|markt|STRASSE|STRAßE|WEG|GASSE|PLATZ)(?:,? Nr\.?)? ?\d{{1,4}}(?: ?[a-z](?!\w))?(?!\d)"),
    re.compile(rf"(?<!\w)(?:{_CAP}(?:er|-)? (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring|Markt)) \d{{1,4}}(?: ?[a-z](?!\w))?(?!\d)"),
]

#: What a text must hold for the last three of them, found faster.
_ROADS = (
    re.compile(r"(?:via|viale|vicolo|piazza|piazzale|corso|largo|calle|strada|borgo|salita|contrada|lungarno|vico) "),  # in small letters
    re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|markt|STRASSE|STRAßE|WEG|GASSE|PLATZ)(?:,? Nr\.?)? ?\d"),
    re.compile(r"(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ufer|Damm|Ring|Markt) \d"),
)

# Names ----------------------------------------------------------------------------------------
#: Particles that belong to the family name that follows (fixed values).
PARTICLES = frozenset("von van de della dello dalla da di del der zu den le la dos das".split())
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*")
#: What may part the words of one name.
_BLANK = re.compile(r"[ \t]{1,3}|\r?\n")
_CAPITAL = re.compile(r"[^\W\d_a-zà-öø-ÿ](?<![^\W\d_].)(?:[^\W\d_]|['’-](?=[^\W\d_]))*", re.S)
_JAVA_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_JAVA_FULL = rf"{_JAVA_NAME}(?:,? (?:\p{{Lu}}\. )?(?:(?:von|van|de|della|da|di|del|d['’]|Della|VON|DELLA) )?(?:d['’])?{_JAVA_NAME}){{1,3}}"
#: Phrases that announce a person, by language (fixed values); a name follows.
CUES = (
    "[Aa]sk for", "[Ll]eft with", "[Ww]e met", "[Rr]efund is for", "[Ll]ast spring", "[Ss]igned(?: by)?[:,]?", "[Aa]ttention", "[Aa]ttn\\.?:?", "[Cc]/o", "[Cc]are of", "on behalf of", "[Cc]ontact:?", "assigned_to:", "owner,", "[Nn]ame:", "[Aa]uthor:", "[Cc]ustomer:",
    "[Mm]y name is", "[Yy]esterday", "[Ss]p(?:eak|oke) (?:to|with)", "[Tt]alk(?:ed)? to", "(?:[Ww]ritten|[Pp]repared|[Rr]eceived|[Ss]ent) by", "[Rr]egards,?", "[Ss]incerely,?", "[Yy]ours(?: truly| faithfully)?,", "[Tt]hanks,", "[Cc]heers,", "Mr\\.?", "Mrs\\.?", "Ms\\.?", "Dr\\.?", "Prof\\.?",
    "[Dd]emandez", "[Hh]ier", "[Cc]olis de", "au nom de", "[Ss]igné(?: par)?[, :]{0,3}", "M\\.", "Mme", "Monsieur", "Madame", "[Jj]e m['’]appelle", "[Cc]ordialement,?", "à l['’]attention de", "[Éé]crit par", "[Aa]ppelez", "[Nn]om ?:",
    "[Pp]aket von", "[Gg]estern hat", "[Gg]estern", "[Rr]echnung geht an", "[Gg]ezeichnet:?", "Herrn?", "Frau", "[Mm]ein Name ist", "[Ii]ch heiße", "[Gg]rüßen?,?", "z\\. ?Hd\\.", "[Gg]eschrieben von", "[Ff]ragen Sie nach",
    "[Pp]acco di", "[Ii]eri", "affidato a", "[Ff]irmato(?: da)?:?", "[Ss]ignor[ae]?", "[Mm]i chiamo", "[Ss]aluti,?", "[Ss]critto da", "[Cc]hied(?:ere|i|ete) di", "all['’]attenzione di",
    "[Mm]e llamo", "[Aa]tentamente,?", "[Ss]eñora?",
)
#: What persons do after their name at a sentence's beginning (fixed values).
ACTS = "wrote|writes|said|called|asked|replied|signed|phoned|complained|a écrit|a appelé|a demandé|schrieb|sagte|rief|fragte|ha scritto|ha detto|ha chiamato|ha chiesto"
#: Two capitalised words in a row, looked for first, for they are rare; then what stands before and after them.
_JAVA_TWO = rf"(?=\p{{Lu}}[\p{{L}}'’-]*\p{{L}},? (?:(?:\p{{Lu}}\. )?(?:von|van|de|della|da|di|del|d['’]|Della|VON|DELLA)? ?(?:d['’])?)\p{{Lu}})"
_CUED = rf"(?<=(?:^|[^\p{{L}}])(?:{'|'.join(CUES)})\s?){_JAVA_FULL}(?= \p{{Ll}}|[.,;\r\n]|  |$)"
_ACTING = rf"(?<=^|[.!?] {{1,2}}|[\r\n]){_JAVA_FULL}(?= (?:{ACTS})(?!\p{{L}}))"
ANNOUNCED = rf"{_JAVA_TWO}(?:{_CUED}|{_ACTING})"
#: Names that are sent to all tasks at most; more are met by a join. The share of its own places in the corpus where a name must be announced: words that begin the sentence after a name are so only by chance.
GAZETTEER, LEAST = 100_000, 0.02


#: Words that begin sentences and are no names (fixed values).
COMMON = frozenset(
    "the of on in at it it's a an and we they they've nobody can call deliver order see when our my i is for this that not no yes please thanks der die das den ein eine in es können könnte außerdem ausserdem später und im am le la les l'on un une on est-ce voilà d'après à il lo gli una la così già perché nella nel misura al di da e rechnung restauro paket yesterday today tomorrow hier demain gestern heute morgen ieri oggi domani".split()
)


def _fold(name: str) -> str:
    return name.replace("’", "'").casefold()


def split_name(full: str) -> tuple[list[str], str] | None:
    """Given names and family name of an announced person; None where it isn't both."""
    if "," in full:
        family, _, given = full.partition(",")
    else:
        words = full.split()
        k = next((i for i, w in enumerate(words) if i and w.casefold() in PARTICLES), len(words) - 1)
        family, given = " ".join(words[k:]), " ".join(words[:k])
    givens = [w for w in given.split() if not w.endswith(".")]
    return ([_fold(w) for w in givens], _fold(family.strip())) if givens and family.strip() else None


def learn_names(texts: DataFrame, text: Column) -> tuple[frozenset[str], frozenset[str]] | DataFrame:
    """Given and family names of the whole corpus, from the places that announce a person: extracted and counted on the JVM side.

    Two sets where they hold GAZETTEER names at most, else a table (name, given, family), which ``found_places`` and ``redacted`` join.
    """
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(ANNOUNCED), F.lit(0))).alias("full")).groupBy("full").agg(F.count("*").alias("n"))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for full, n in zip(pdf["full"], pdf["n"], strict=True):
                if cut := split_name(full):
                    rows += [(g, "given", n) for g in cut[0]] + [(cut[1], "family", n)]
            yield pd.DataFrame(rows, columns=["name", "kind", "n"])

    counted = found.mapInPandas(parts, "name string, kind string, n long").groupBy("name").agg(F.sum(F.when(F.col("kind") == "given", F.col("n")).otherwise(0)).alias("g"), F.sum(F.when(F.col("kind") == "family", F.col("n")).otherwise(0)).alias("f"))
    # Both figures grow with the corpus alike. A name of more than one word goes by its last.
    capitals = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}'’-])\p{Lu}[\p{L}'’-]*"), F.lit(0))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    seen = capitals.mapInPandas(_folded, "word string, n long").groupBy("word").agg(F.sum("n").alias("seen"))
    counted = counted.withColumn("word", F.element_at(F.split("name", " "), -1)).join(seen, "word", "left")
    # A name announced in both places counts where it is more at home, by a fifth at least.
    named = counted.where(F.col("g") + F.col("f") >= LEAST * F.coalesce("seen", F.lit(0))).where(~F.split("name", r"\s+")[0].isin(*COMMON))
    named = named.select("name", F.expr("g > 0 and 5 * g >= f").alias("given"), F.expr("f > 0 and 5 * f >= g").alias("family")).where("given or family")
    named = storage.staged(named, "names")
    few = named.limit(GAZETTEER + 1).collect()
    return _two(few) if len(few) <= GAZETTEER else named


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"word": [_fold(w) for w in pdf["raw"]], "n": pdf["n"]})


def _two(rows: list) -> tuple[frozenset[str], frozenset[str]]:
    return frozenset(r["name"] for r in rows if r["given"]), frozenset(r["name"] for r in rows if r["family"])


class Names:
    """Finds full names whose parts the gazetteers know."""

    def __init__(self, given: frozenset[str], family: frozenset[str]) -> None:
        self.given, self.family = given, family
        self.starts = frozenset(f.split()[0] for f in family)

    def _family(self, words: list[re.Match], k: int, text: str) -> int:
        """The number of words of a family name at word k; nought where there is none."""
        for n in (3, 2, 1):
            if k + n <= len(words) and all(_BLANK.fullmatch(text, words[i - 1].end(), words[i].start()) for i in range(k + 1, k + n)) and " ".join(_fold(w[0]) for w in words[k : k + n]) in self.family:
                return n if words[k + n - 1][0][:1].isupper() or "'" in _fold(words[k + n - 1][0])[:2] else 0
        return 0

    def _forward(self, words: list[re.Match], k: int, text: str, given: Callable[[int], bool], gap: Callable[[int], str]) -> int:
        """The word after a full name in natural order that starts at given name k; nought where none does."""
        i = k + 1
        while i < len(words) and i - k <= 3 and (_BLANK.fullmatch(gap(i - 1)) or len(words[i - 1][0]) == 1 and gap(i - 1) in (". ", ".", ".\n")):
            if n := self._family(words, i, text):
                return i + n
            if not (given(i) or len(words[i][0]) == 1 and words[i][0].isupper()):
                return 0
            i += 1
        return 0

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        named = {w for w in set(_CAPITAL.findall(text)) if _fold(w) in self.given}
        if not named:
            return  # without a given name there is no full name
        words = list(_WORD.finditer(text))
        gap = lambda i: text[words[i].end() : words[i + 1].start()]  # noqa: E731 - between word i and the next
        given = lambda i: i < len(words) and words[i][0] in named
        # A full name begins at a given name or, family first, up to three words before one.
        starts = sorted({k for i, w in enumerate(words) if w[0] in named for k in range(max(0, i - 3), i + 1)})
        free = 0
        for k in starts:
            w = words[k]
            if k < free or k >= len(words) - 1 or not (w[0][:1].isupper() or _fold(w[0]) in self.starts):
                continue
            if end := self._forward(words, k, text, given, gap) if given(k) else 0:
                yield w.start(), words[end - 1].end()
                free = end
            elif (n := self._family(words, k, text)) and k + n < len(words) and re.fullmatch(r",(?:[ \t]{1,3}|\r?\n)", gap(k + n - 1)) and given(k + n):
                end = k + n
                while end + 1 < len(words) and gap(end) in (" ", ". ") and (given(end + 1) or len(words[end + 1][0]) == 1 and words[end + 1][0].isupper() and text[words[end + 1].end() : words[end + 1].end() + 1] == "."):
                    end += 1
                yield w.start(), words[end].end()
                free = end + 1


def _around(t: str) -> list[tuple[int, int]]:
    """The stretches of a text around its runs of digits, apart from each other."""
    out: list[tuple[int, int]] = []
    for m in _RUN.finditer(t):
        low, high = max(0, m.start() - _REACH_BACK), min(len(t), m.end() + _REACH_ON)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def places(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every place in source characters, in order and apart from each other."""
    plain = Plain(text)
    t = plain.text
    found: list[tuple[int, int, str]] = [(m.start(), m.end(), "email") for m in _EMAIL.finditer(t)] if "@" in t else []
    for low, high in _around(t):
        found += [(m.start(g), m.end(g), "id_number") for p, g in _IDS for m in p.finditer(t, low, high)]
        found += [(m.start(), m.end(), "phone") for p in _PHONES for m in p.finditer(t, low, high) if not _NO_PHONE.search(t, max(0, m.start() - 16), m.start())]
    if _FISCAL_END.search(t):
        found += [(m.start(1), m.end(1), "id_number") for m in _FISCAL.finditer(t)]
    hints = (True, True, _ROADS[0].search(t.lower()) or _FOLDS.search(t), _ROADS[1].search(t), _ROADS[2].search(t))
    found += [(m.start(), m.end(), "address") for p, hint in zip(_ADDRESSES, hints, strict=True) if hint for m in p.finditer(t)]
    found += [(a, b, "name") for a, b in names.find(t)]
    rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    kept: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for a, b, kind in sorted(found, key=lambda x: (rank[x[2]], x[0], -x[1])):
        k = bisect_right(taken, (a, len(t) + 1))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b))
            kept.append((plain.source(a), plain.source(b, end=True), kind))
    return sorted(kept)


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def replaced(text: str, spots: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spots:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(out) + text[at:]


def _name_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word of a text that may be a given name or the last word of a family name."""
    for pdf in frames:
        rows = [(h, w) for h, t in zip(pdf["h"], pdf["text"], strict=True) for w in {_fold(w) for w in _WORD.findall(Plain(t).text) if w[:1].isupper() or "'" in _fold(w)[:2]}]
        yield pd.DataFrame(rows, columns=["h", "word"])


def _with_names(rows: DataFrame, names: tuple[frozenset[str], frozenset[str]] | DataFrame) -> DataFrame:
    """``rows`` of (key, text) with ``known``, the names of a large gazetteer that a text's words end; null for sets, which all tasks have.

    Texts are met by their hash: two that share one get each other's names too, which changes nothing.
    """
    if not isinstance(names, DataFrame):
        return skew.spread(rows.withColumn("known", F.lit(None).cast("array<struct<name:string,given:boolean,family:boolean>>")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    words = skew.spread(rows.where("text is not null").select("h", "text")).mapInPandas(_name_keys, "h long, word string").distinct()
    met = words.join(names.withColumn("word", F.element_at(F.split("name", " "), -1)), "word").groupBy("h").agg(F.collect_set(F.struct("name", "given", "family")).alias("known"))
    return rows.join(met, "h", "left").select("key", "text", F.coalesce("known", F.array().cast("array<struct<name:string,given:boolean,family:boolean>>")).alias("known"))


def _knowing(pdf: pd.DataFrame, everywhere: Names | None) -> Iterator[Names]:
    """The names for each row of a batch."""
    for known in pdf["known"]:
        yield everywhere or Names(*_two(known))


def found_places(texts: DataFrame, key: Column, text: Column, names: tuple[frozenset[str], frozenset[str]] | DataFrame) -> DataFrame:
    """(key, kind, char_start, char_end): one row per place, in code points of the source. Null and empty texts have none."""
    sets = None if isinstance(names, DataFrame) else names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everywhere = sets and Names(*sets)
        for pdf in frames:
            rows = [(k, kind, a, b) for k, t, known in zip(pdf["key"], pdf["text"], _knowing(pdf, everywhere), strict=True) for a, b, kind in places(t, known)]
            yield pd.DataFrame(rows, columns=["key", "kind", "char_start", "char_end"])

    rows = texts.select(key.cast("long").alias("key"), text.alias("text")).where("text is not null")
    return _with_names(rows, names).mapInPandas(run, "key long, kind string, char_start long, char_end long")


def redacted(texts: DataFrame, key: Column, text: Column, names: tuple[frozenset[str], frozenset[str]] | DataFrame) -> DataFrame:
    """(key, text, places): every row with placeholders in its text. A null text stays null and has no places."""
    sets = None if isinstance(names, DataFrame) else names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everywhere = sets and Names(*sets)
        for pdf in frames:
            spots = [[] if t is None else places(t, known) for t, known in zip(pdf["text"], _knowing(pdf, everywhere), strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "text": [None if t is None else replaced(t, s) for t, s in zip(pdf["text"], spots, strict=True)], "places": [len(s) for s in spots]})

    return _with_names(texts.select(key.cast("long").alias("key"), text.alias("text")), names).mapInPandas(run, "key long, text string, places long")
