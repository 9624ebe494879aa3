"""Words, passages, chunks and decoding as column expressions; Python only where Unicode decomposition needs it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ligatures that don't decompose (fixed values).
LIGATURES = {"æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ß": "ss"}
#: Letters, digits and marks beyond the Latin blocks, and symbols that decompose into letters: these need full decomposition.
_BEYOND = r"[[\p{L}\p{N}&&[^\x{0}-\x{24F}]]\x{2100}-\x{214F}\x{2460}-\x{24FF}\x{3200}-\x{33FF}\x{FB00}-\x{FB4F}\x{FF00}-\x{FFEF}\x{A8}\x{B4}\x{B8}\x{BC}-\x{BE}\x{132}\x{133}\x{13F}\x{140}\x{149}\x{17F}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}]"


def _latin() -> tuple[str, str]:
    """Latin letters that decompose into one base character, and their bases; by rule, not by list."""
    source, target = [], []
    for cp in range(0xA0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp):
            source.append(chr(cp))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _latin()


def fold(text: Column) -> Column:
    """Accents and ligatures of Latin text folded."""
    out = F.translate(text, _FROM, _TO)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def python_tokens(text: str) -> list[str]:
    """The rule for any script: decompose, drop marks, compose what is left (syllables of Hangul), fold ligatures, lower, runs of letters and digits."""
    t = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))
    return re.findall(r"[^\W_]+", t.translate(str.maketrans(LIGATURES)).lower())


def with_tokens(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """Rows with their words. Latin text stays on the JVM side; of texts in other scripts alone anything but a null goes through Python. A null text has no words."""

    @F.pandas_udf("array<string>")
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else python_tokens(t))

    beyond = F.col(text).rlike(_BEYOND)
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.col(text)), r"\p{M}+", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    plain = F.transform(words, lambda w: F.when(w.rlike("^[a-z0-9]+$"), w).otherwise(fold(w)))
    rows = df.withColumn("__beyond", F.coalesce(beyond, F.lit(False))).withColumn("__foreign", tokens(F.when(F.col("__beyond"), F.col(text))))
    return rows.withColumn(name, F.coalesce(F.col("__foreign"), F.when(~F.col("__beyond"), plain), F.array())).drop("__beyond", "__foreign")


#: Words that the stemming tokenizer leaves out (fixed values).
STOP = "a an and are as at be by can do does for from has have how i if in is it its my of on or our so that the their this to was we what when where which will with you your me after before get any did should there his he were".split()


def stems(text: Column) -> Column:
    """Lower-case runs of a-z and digits without stop words, each without the first of ing, ed, es, s that ends a word of over four letters."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOP))

    def stem(w: Column) -> Column:
        long = F.length(w) > 4
        out = F.when(long & w.endswith("ing"), w.substr(F.lit(1), F.length(w) - 3))
        for suffix in ("ed", "es", "s"):
            out = out.when(long & w.endswith(suffix), w.substr(F.lit(1), F.length(w) - len(suffix)))
        return out.otherwise(w)

    return F.transform(words, stem)


_BLANKS = r"[ \t\n\x0B\f\r]"
MAX_CHARS = 1_200


def passages(text: Column, most: int = MAX_CHARS) -> Column:
    """Paragraphs, blanks collapsed, packed greedily into at most ``most`` characters at word boundaries; a longer word stays whole."""
    paragraphs = F.split(text, rf"\r?\n{_BLANKS}*\r?\n")
    clean = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, rf"{_BLANKS}+", " ")))

    def pack(p: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def add(acc: Column, w: Column) -> Column:
            full = (F.length(acc["now"]) > 0) & (F.length(acc["now"]) + F.length(w) + 1 > most)
            joined = F.when(F.length(acc["now"]) > 0, F.concat(acc["now"], F.lit(" "), w)).otherwise(w)
            return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(full, w).otherwise(joined).alias("now"))

        return F.aggregate(F.split(p, " "), start, add, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda x: F.length(x) > 0))

    # A paragraph within the limit needs no packing.
    return F.flatten(F.transform(clean, lambda p: F.when(F.length(p) <= most, F.filter(F.array(p), lambda x: F.length(x) > 0)).otherwise(pack(p))))


def title(text: Column, fallback: Column) -> Column:
    """The first line without blanks of any kind and brackets at its ends, or the fallback."""
    strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    first = strip(F.btrim(strip(F.substring_index(text, "\n", 1)), F.lit("[]")))
    return F.coalesce(F.when(F.length(first) > 0, first), fallback)


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, encoding) of bytes: strict UTF-8, else ISO-8859-1."""
    ok = F.is_valid_utf8(content.cast("string"))
    return F.when(ok, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), F.when(ok, "utf-8").otherwise("iso-8859-1")


def fixed_chunks(text: Column, size: int = 300, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters, each starting size - overlap after the one before."""
    step = size - overlap
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda k: F.substr(text, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def heading_chunks(body: Column) -> Column:
    """(heading, slug, text) of each ``## `` section with text: lines trimmed and joined, ``# `` lines left out. What precedes the first is dropped."""
    sections = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace(body, "\r\n?", "\n")), "\n## "), 2, 1_000_000)

    def section(s: Column) -> Column:
        heading = F.trim(F.substring_index(s, "\n", 1))
        rest = F.when(F.instr(s, "\n") > 0, F.substr(s, F.instr(s, "\n") + 1)).otherwise(F.lit(""))
        lines = F.filter(F.split(rest, "\n"), lambda x: (F.length(F.trim(x)) > 0) & ~x.startswith("# "))
        return F.struct(heading.alias("heading"), F.replace(F.lower(heading), F.lit(" "), F.lit("-")).alias("slug"), F.array_join(F.transform(lines, lambda x: F.trim(x)), " ").alias("text"))

    return F.filter(F.transform(sections, section), lambda x: (F.length(x["heading"]) > 0) & (F.length(x["text"]) > 0))


def card(page_title: Column, heading: Column, text: Column) -> Column:
    """What an index sees of a chunk."""
    return F.concat(page_title, F.lit(" > "), heading, F.lit("\n"), text)


#: A restorer's words and the archive's words for them (fixed values).
THESAURUS = {
    r"\b(hole|gap|missing|damaged area)\b": "lacuna loss",
    r"\b(flaking|peeling|coming off)\b": "lifting",
    r"\bscales\b": "balance",
    r"\b(sketch|study)\b": "drawing disegno",
    r"\bunderdrawing\b": "sinopia infrared",
    r"\b(gold|gilt)\b": "gilded leaf",
    r"\bblue\b": "azurite ultramarine",
    r"\bred\b": "vermilion lake",
    r"\b(old|historic) photo\w*\b": "photograph 1931",
    r"\b(painter|artist)\b": "jacopo",
    r"\bpaid\b": "florins payment",
    r"\bwhite (crust|bloom|deposits?)\b": "efflorescence salts",
}


def expanded(query: Column, rules: dict[str, str] = THESAURUS) -> Column:
    """The query with the words of every rule that it matches, in the order of the rules."""
    return F.concat_ws(" ", query, *[F.when(F.lower(query).rlike(p), F.lit(words)) for p, words in rules.items()])


def letter_shard(word: Column, shards: int) -> Column:
    """The shard of a word by its first letter; words that don't begin with a-z are in the first."""
    a = F.ascii(word)
    return F.when((a >= 97) & (a <= 122), F.floor((a - 97) * shards / 26)).otherwise(0).cast("int")


def hash_shard(key: Column, shards: int) -> Column:
    return F.pmod(F.hash(key), F.lit(shards)).cast("int")
