"""Text decoded with the wrong character encoding: find it and put the original back.

A sentence's candidate readings are the chains of one or two wrong decodings that it could have come from.
Each candidate, and the sentence as it is, is compressed with the zstandard dictionary of each language; the
shortest description wins, where a chain costs bytes of its own and characters that no author types (controls,
the replacement character) are charged to the reading that keeps them.  If the sentence as it is wins, it stays.

The dictionaries are trained on all sentences of the passages themselves, in parts that are merged; known words and
letters are counted over all passages.  Passages with a word that another reading turns into a more frequent one are
left out, and so is, in a second round, what the first dictionaries find garbled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import skew, storage

#: Fixed parameters: passages of a language whose sentences train a dictionary in one task (more make further parts), characters of a sample (a longer sentence makes several), bytes of a dictionary.
SAMPLE, SAMPLE_CHARS, DICT_BYTES = 6_000, 20_000, 1 << 17
#: Characters of a part at most, dictionaries that are merged at once, and the bytes of their content that make a sample then.
PART_CHARS, MERGED, MERGED_BYTES = 1 << 24, 64, 256
#: Bytes that a chain costs (its first step, each further one) and that must be gained beyond (more where single characters are mapped, which always can be); bytes charged for each character that no author types, each that the alphabet lacks, each word beyond ASCII that isn't known.
STEP_COST, MORE_COST, MARGIN, PAIR_MARGIN, CHARGE, FOREIGN, UNKNOWN = 1, 2, 1, 3, 3, 2, 2

#: Encodings that bytes were read in, and those that write several bytes a character. A pair with utf-8 undoes whole byte sequences.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866", "iso8859-2", "cp1253", "cp1254")
READ_WIDE = ("gbk", "big5", "shift_jis", "euc_kr")
#: Pairs of encodings of one byte map single characters: all pairs of these, the first ones first among equal readings.
_ONE_BYTE = ("cp1252", "mac_roman", "latin-1", "cp850", "cp437", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-15", "iso8859-2", "cp1253", "cp1254", "cp1257")
SINGLE = tuple((w, r) for w in _ONE_BYTE for r in _ONE_BYTE if w != r)

#: Words that tell the languages of the dictionaries apart (fixed values).
STOPWORDS = {
    "en": "the of and was is in that for it with on as at by we had to but not this from are be which an were a".split(),
    "fr": "le la les de des du et est un une dans que qui pour par sur au aux ne pas plus a en fut mais où".split(),
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem es im für hieß wurde steht".split(),
    "it": "il la le di che e un una in per con non del della è sono più da nel lo gli al dal si".split(),
    "pt": "o a os as de que e do da em um uma para com não no na por mais dos das ao foi".split(),
}

_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_RUN = re.compile(r"[^\x00-\x7f]{2,}")  # a byte sequence has two characters at least
_WORD = re.compile(r"[^\s\x00-\x40\[-`{-~]*[^\x00-\x7f][^\s\x00-\x40\[-`{-~]*")
#: Words and blanks beyond ASCII between ASCII signs.
_CHUNK = re.compile(r"[^\x00-\x40\[-`{-~]*[^\x00-\x7f][^\x00-\x40\[-`{-~]*")
_SENTENCE = re.compile(r"(?<=[.!?;])[ \t\r\n]+")
#: Words of three or more letters in one script other than Latin: foreign, but nothing odd.
_SCRIPT = re.compile("[Ͱ-Ͽἀ-῿]{3,}|[Ѐ-ԯ]{3,}|[가-힣]+|[぀-ヿ㐀-鿿]+|[֐-׿]{3,}|[؀-ۿ]{3,}")
_IMPOSSIBLE = re.compile("[\x80-\x9f�]")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _upper_half(codec: str) -> dict[str, int]:
    """Characters of bytes 128 to 255; bytes that the encoding leaves undefined read as controls, as browsers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_BYTES = {codec: _upper_half(codec) for codec in {*READ_AS, *_ONE_BYTE}}


def _pair_table(written: str, read: str) -> dict[int, str]:
    back = {b: c for c, b in _BYTES[written].items()}
    return {ord(c): back[b] for c, b in _BYTES[read].items() if back[b] != c}


_PAIRS = {f"{w}>{r}": _pair_table(w, r) for w, r in SINGLE}
#: Known words that are sent to all tasks at most; more are met by a join.
KNOWN_WORDS = 500_000
_CHAINS = tuple(_PAIRS)
_image_lists: dict[str, tuple[str, ...]] = {}


def _images(c: str) -> tuple[str, ...]:
    """What each pair makes of a character."""
    if c not in _image_lists:
        _image_lists[c] = tuple(table.get(ord(c), c) for table in _PAIRS.values())
    return _image_lists[c]


def _alike(odd: str) -> dict[tuple[str, ...], list[int]]:
    """The pairs by what they make of some characters; those that change none are left out."""
    out: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for k, images in enumerate(zip(*map(_images, odd), strict=True)):
        out[images].append(k)
    out.pop(tuple(odd), None)
    return out


def _every(text: str) -> list[str]:
    odd = "".join(dict.fromkeys(_NON_ASCII.findall(text)))
    return [_CHAINS[chains[0]] for chains in _alike(odd).values()] if odd else []


#: Characters of the scripts that several bytes make where the text is Latin, and what is remembered of runs and words at most.
_WIDE, REMEMBERED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]"), 200_000
_WIDE_RUN = re.compile("[^\x00-\x7f]+[\x40-\x7e]?")


def undo_wide(text: str, read: str) -> str:
    """Put back the characters whose utf-8 bytes were read as ``read``, two at a time; a run that isn't such bytes stays. A letter after it may have been swallowed."""

    def run(m: re.Match) -> str:
        for end in (m.end(), m.end() - 1):
            part = m[0][: end - m.start()]
            try:
                return part.encode(read).decode("utf-8") + m[0][len(part) :]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m[0]

    return _WIDE_RUN.sub(run, text)


_runs: dict[tuple[str, str], str] = {}


def undo_utf8(text: str, read: str) -> str:
    """Put back the characters whose utf-8 bytes were read as ``read``; everything else stays."""
    table = _BYTES[read]

    def run(m: re.Match) -> str:
        s = m[0]
        known = _runs.get((s, read))
        if known is not None:
            return known
        raw = bytes(table.get(c, 0x20) for c in s)
        out, at = [], 0
        for u in _UTF8.finditer(raw):
            out.append(s[at : u.start()])
            out.append(u[0].decode())
            at = u.end()
        whole = "".join(out) + s[at:] if at else s
        if len(_runs) >= REMEMBERED:
            _runs.clear()
        if len(s) <= 16:
            _runs[s, read] = whole
        return whole

    # A byte order mark that was read as text is no character of the author's.
    return _RUN.sub(run, text).removeprefix("\ufeff")


def candidates(text: str, pairs: Callable[[str], Iterable[str]] | None = None) -> dict[str, tuple[str, int]]:
    """Other readings of a text: chain to (reading, cost in bytes); of chains with one reading the cheapest.

    ``pairs`` names the pairs of encodings that are worth a try on a text; without it all are, one of those that read it alike.
    """
    found: dict[str, tuple[str, int]] = {}

    def add(reading: str, chain: str, cost: int) -> bool:
        if reading == text or reading in found and found[reading][1] <= cost:
            return False
        found[reading] = (chain, cost)
        return True

    onces = []
    for r in READ_AS if _RUN.search(text) else ():
        once = undo_utf8(text, r)
        if once != text and add(once, f"utf-8>{r}", STEP_COST):
            onces.append((once, f"utf-8>{r}"))
            for r2 in READ_AS if _RUN.search(once) else ():
                twice = undo_utf8(once, r2)
                if twice != once:
                    add(twice, f"utf-8>{r2}>utf-8>{r}", STEP_COST + MORE_COST)
                    thrice = undo_utf8(twice, r2)
                    if thrice != twice:
                        add(thrice, f"utf-8>{r2}>utf-8>{r2}>utf-8>{r}", STEP_COST + 2 * MORE_COST)
    for r in READ_WIDE if _WIDE.search(text) else ():
        once = undo_wide(text, r)
        if once != text and add(once, f"utf-8>{r}", STEP_COST):
            onces.append((once, f"utf-8>{r}"))
    for chain in pairs(text) if pairs else _every(text):
        add(text.translate(_PAIRS[chain]), chain, STEP_COST)
    for once, before in onces if pairs else ():
        for chain in pairs(once):
            add(once.translate(_PAIRS[chain]), f"{chain}>{before}", STEP_COST + MORE_COST)
    if "�" in text:
        add(text.replace("�", ""), "lost", STEP_COST)
    return {chain: (reading, cost) for reading, (chain, cost) in found.items()}


def language(sentence: str) -> str | None:
    """The language whose frequent words a sentence has most of; None where it has none."""
    words = re.findall(r"[^\W\d_]+", sentence.casefold())
    best = max(STOPWORDS, key=lambda k: sum(w in _STOP[k] for w in words))
    return best if any(w in _STOP[best] for w in words) else None


_STOP = {k: frozenset(v) for k, v in STOPWORDS.items()}


def even_bytes(text: str) -> bytes:
    """Three bytes for each character beyond ASCII, so that no reading is shorter for its script alone."""
    return _NON_ASCII.sub(lambda m: f"\x0f{chr(32 + ord(m[0]) % 90)}{chr(32 + ord(m[0]) // 90 % 90)}" if ord(m[0]) < 0x10000 else "\x0e..", text).encode("utf-8", "replace")


class Reader:
    """Compressors with the languages' dictionaries, and words known to be read rightly."""

    def __init__(self, dictionaries: dict[str, bytes], known: frozenset[str], alphabet: frozenset[str]) -> None:
        import zstandard

        self.known, self.alphabet = known, alphabet
        self.compressors, self._ways = {}, {}
        for k, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if not content.startswith(b"\x37\xa4\x30\xec") else zstandard.ZstdCompressionDict(content)
            data.precompute_compress(level=9)
            self.compressors[k] = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def knows(self, words: frozenset[str]) -> None:
        """Take other words for known."""
        self.known, self._ways = words, {}

    def bytes_of(self, text: str) -> int:
        raw = even_bytes(text)
        return min((len(c.compress(raw)) for c in self.compressors.values()), default=len(raw))

    def describe(self, text: str) -> int:
        odd = _NON_ASCII.findall(_SCRIPT.sub("", text))
        return self.bytes_of(text) + CHARGE * len(_IMPOSSIBLE.findall(text)) + FOREIGN * sum(c not in self.alphabet for c in odd) + UNKNOWN * sum(w not in self.known for w in _WORD.findall(text))

    def pairs(self, text: str) -> list[str]:
        """The pairs of encodings, in their order, that make a known word in a text or a known letter of an impossible character; of pairs that read it alike the first.

        A text is looked at chunk by chunk: no pair changes the ASCII signs and blanks between chunks.
        """
        found: set[int] = set()
        for chunk in set(_CHUNK.findall(text)):
            ways = self._ways.get(chunk)
            if ways is None:
                odd = "".join(dict.fromkeys(_NON_ASCII.findall(chunk)))
                ways = []
                for images, chains in _alike(odd).items():
                    if any(w in self.known for w in _WORD.findall(chunk.translate(dict(zip(map(ord, odd), images, strict=True))))):
                        ways += chains
                if len(self._ways) >= REMEMBERED:
                    self._ways.clear()
                self._ways[chunk] = ways = tuple(ways)
            found.update(ways)
        for c in set(_IMPOSSIBLE.findall(text)):
            found.update(k for k, image in enumerate(_images(c)) if image in self.alphabet)
        if not found:
            return []
        odd = "".join(dict.fromkeys(_NON_ASCII.findall(text)))
        first = {tuple(_images(c)[k] for c in odd): k for k in sorted(found, reverse=True)}
        return [_CHAINS[k] for k in sorted(first.values())]

    def sentence(self, text: str) -> tuple[str, str | None]:
        """The best reading and its chain, None where the text stays."""
        if not _NON_ASCII.search(text) or all(w in self.known for w in _WORD.findall(text)) and not _IMPOSSIBLE.search(text):
            return text, None
        impossible = len(_IMPOSSIBLE.findall(text))
        before, capitals = set(_WORD.findall(text)), sum(c.isupper() for c in text) > sum(c.islower() for c in text)
        open_ = []
        for chain, (reading, cost) in candidates(text, self.pairs).items():
            after = set(_WORD.findall(reading))
            gone, new = before - after, after - before
            if any(len(w) > 2 and w in self.known for w in gone):
                continue  # a word known to be right would be lost
            cured = len(_IMPOSSIBLE.findall(reading)) < impossible
            single = chain.split(">utf-8>")[0] in _PAIRS
            if single and not cured and not any(w in self.known and (len(w) > 1 or not w.isalpha() or not capitals) for w in new):
                continue  # single characters can always be mapped: a known word must come of it, in capitals more than a letter
            open_.append((chain, reading, cost, PAIR_MARGIN if single else MARGIN))
        if not open_:
            return text, None
        as_is = best = self.describe(text)
        chosen = (text, None)
        for chain, reading, cost, margin in open_:
            n = self.describe(reading) + cost
            if n < best and n < as_is - margin:
                best, chosen = n, (reading, chain)
        return chosen

    def passage(self, text: str) -> tuple[str, list[str]]:
        """The restored text and the chains used; sentences that lost characters stay as they are and give 'lost'."""
        out, chains, at = [], [], 0
        cuts = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)] + [(len(text), len(text))]
        for a, b in cuts:
            reading, chain = self.sentence(text[at:a])
            if chain:
                lost = "�" in text[at:a]
                chains.append("lost" if lost else chain)
                reading = text[at:a] if lost else reading
            out.append(reading + text[a:b])
            at = b
        return "".join(out), chains


def _doubtful(words: Counter) -> set[str]:
    """Words of three or more characters that some reading turns into a more frequent word, or that undoing utf-8 turns into any word at all: that way back is none by chance, however often the garbled word stands. A word that it leaves plain had a byte order mark before it."""
    return {w for w, n in words.items() if len(w) > 2 and any(r.isascii() or words.get(r, 0) > 0 if chain.startswith("utf-8>") else words.get(r, 0) > n for chain, (r, _) in candidates(w).items())}


def train(samples: list[str]) -> tuple[dict[str, bytes], frozenset[str], frozenset[str]]:
    """Dictionaries by language ('other' holds what no language claims), known words and the alphabet, from passages in memory; ``trained`` is the same over a table."""
    words: Counter = Counter()
    for t in samples:
        words.update(set(_WORD.findall(t)))
    doubtful = _doubtful(words)
    kept = [t for t in samples if not _IMPOSSIBLE.search(t) and doubtful.isdisjoint(_WORD.findall(t))]
    model = _learn(kept)
    reader = Reader(*model)
    return _learn([t for t in kept if not reader.passage(t)[1]])


def _learn(passages: list[str]) -> tuple[dict[str, bytes], frozenset[str], frozenset[str]]:
    words, letters = Counter(), Counter()
    for t in passages:
        words.update(set(_WORD.findall(t)))
        letters.update(set(_NON_ASCII.findall(t)))
    known = frozenset(w for w, n in words.items() if n >= 3 and (len(w) > 1 or n >= 20 and not w.isupper()))
    return _dictionaries(passages), known, frozenset(c for c, n in letters.items() if n >= 3)


def _pieces(text: str) -> list[str]:
    """The sentences of a text as samples; one longer than SAMPLE_CHARS makes several."""
    return [s[i : i + SAMPLE_CHARS] for s in _SENTENCE.split(text) for i in range(0, len(s), SAMPLE_CHARS)]


def _languages(text: str) -> list[str]:
    return [language(s) or "other" for s in _pieces(text)]


def _blocks(text: str, languages: Iterable[str], met: Counter) -> list[tuple[str, int, list[str]]]:
    """(language, place, sentences) of each stretch of SAMPLE_CHARS of a passage. The place is a hash of the text, of the stretch and of how often the text was met before, so that long and repeated passages spread."""
    digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
    if len(met) >= REMEMBERED:
        met.clear()
    met[digest] += 1
    by: dict[tuple[str, int], list[str]] = defaultdict(list)
    at = 0
    for k, s in zip(languages, _pieces(text), strict=True):
        by[k, at // SAMPLE_CHARS].append(s)
        at += len(s)
    place = lambda stretch: int.from_bytes(hashlib.blake2b(digest + met[digest].to_bytes(8) + stretch.to_bytes(8), digest_size=8).digest(), signed=True)
    return [(k, place(stretch), sentences) for (k, stretch), sentences in by.items()]


def _dictionaries(passages: list[str]) -> dict[str, bytes]:
    by: dict[str, list[str]] = defaultdict(list)
    met: Counter = Counter()
    for k, _, sentences in sorted(block for t in passages for block in _blocks(t, _languages(t), met)):
        by[k] += sentences
    return {k: _dictionary(v) for k, v in by.items()}


def _dictionary(sentences: list[str]) -> bytes:
    """A dictionary of sentences, as often as they stand. Every third also counts in capitals."""
    raw = [even_bytes(s) for s in sentences] + [even_bytes(s.upper()) for s in sentences[::3]]
    return _fitted(raw, b"\n".join(dict.fromkeys(raw)))


def _fitted(samples: list[bytes], plain: bytes) -> bytes:
    """A dictionary trained on all samples (by default a quarter would only judge it); of few samples their plain content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=9, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return plain[-DICT_BYTES:] or b"\n"


#: What ends the tables before a trained dictionary's content: its three first offsets, always these.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def _content(dictionary: bytes) -> bytes:
    at = dictionary.find(_OFFSETS, 0, 1024) if dictionary.startswith(b"\x37\xa4\x30\xec") else -1
    return dictionary[at + len(_OFFSETS) :] if at >= 0 else dictionary


def _merged(dictionaries: list[bytes]) -> bytes:
    """One dictionary of several parts' ones: trained on their contents, where what most parts hold counts most."""
    if len(dictionaries) == 1:
        return dictionaries[0]
    contents = [_content(d) for d in dictionaries]
    return _fitted([c[i : i + MERGED_BYTES] for c in contents for i in range(0, len(c), MERGED_BYTES)], b"\n".join(contents))


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pdf.assign(words=[list(set(_WORD.findall(t))) for t in pdf["t"]], letters=[list(set(_NON_ASCII.findall(t))) for t in pdf["t"]], impossible=[bool(_IMPOSSIBLE.search(t)) for t in pdf["t"]], languages=[_languages(t) for t in pdf["t"]])


def _word_readings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        readings = [(w, n, chain.startswith("utf-8>"), r) for w, n in zip(pdf["word"], pdf["n"], strict=True) for chain, (r, _) in candidates(w).items()]
        # Plain words aren't counted: what undoing utf-8 leaves plain meets itself.
        rows = [(w, 0 if utf8 else n, w if r.isascii() else r) for w, n, utf8, r in readings if utf8 or not r.isascii()]
        yield pd.DataFrame(rows, columns=["word", "n", "reading"])


def _counted(passages: DataFrame, of: str, name: str) -> DataFrame:
    return passages.select(F.explode(of).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


#: Dictionaries by language, known words (a set, or a table of them where they are many), the alphabet.
Model = tuple[dict[str, bytes], "frozenset[str] | DataFrame", frozenset[str]]


def _samples(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    met: Counter = Counter()
    for pdf in frames:
        yield pd.DataFrame([block for t, languages in zip(pdf["t"], pdf["languages"], strict=True) for block in _blocks(t, languages, met)], columns=["language", "place", "sentences"])


def _part_trained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sentences = [s for some in pdf.sort_values("place")["sentences"] for s in some]
    return pd.DataFrame({"language": [key[0]], "part": [key[1]], "dictionary": [_dictionary(sentences)]})


def _parts_merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"language": [key[0]], "part": [key[1]], "dictionary": [_merged(list(pdf.sort_values("part")["dictionary"]))]})


def _parts(rows: DataFrame) -> dict[str, int]:
    """In how many parts each language is trained, by its passages and their characters."""
    sizes = rows.select(F.explode(F.array_distinct("languages")).alias("language"), F.length("t").alias("chars")).groupBy("language").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return {r["language"]: max(-(-r["n"] // SAMPLE), -(-r["chars"] // PART_CHARS)) for r in sizes.collect()}


def _dictionaries_of(kept: DataFrame, parts: dict[str, int]) -> dict[str, bytes]:
    """Dictionaries by language of all sentences of a table: passages, long ones in stretches, are dealt to parts by hash, each part trains one on all its sentences, and those of up to MERGED parts are merged until each language has one."""
    if not parts:
        return {}

    def share(counts: dict[str, int], place: Column) -> Column:
        return F.pmod(place, F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, n)])[F.col("language")]).cast("long")

    tasks = max(4 * kept.sparkSession.sparkContext.defaultParallelism, sum(parts.values()) // 8)
    samples = skew.spread(kept.select("t", "languages")).mapInPandas(_samples, "language string, place long, sentences array<string>").withColumn("part", share(parts, F.col("place")))
    result = "language string, part long, dictionary binary"
    out = samples.repartition(tasks, "language", "part").groupBy("language", "part").applyInPandas(_part_trained, result)
    while max(parts.values()) > 1:
        parts = {k: -(-n // MERGED) for k, n in parts.items()}
        out = out.withColumn("into", share(parts, F.col("part"))).repartition(max(len(parts), sum(parts.values()) // 8), "language", "into").groupBy("language", "into").applyInPandas(_parts_merged, result)
    return {r["language"]: bytes(r["dictionary"]) for r in sorted(out.collect())}


def _model(kept: DataFrame, parts: dict[str, int]) -> Model:
    """Words and letters are counted over all passages, and all their sentences train the dictionaries."""
    counted = _counted(kept, "words", "word").where("n >= 3 and (length(word) > 1 or n >= 20)").where((F.length("word") > 1) | (F.col("word") == F.lower("word")))
    counted = storage.staged(counted.select("word"), "known")
    few = counted.limit(KNOWN_WORDS + 1).collect()
    letters = _counted(kept, "letters", "letter").where("n >= 3").collect()
    known = frozenset(r["word"] for r in few) if len(few) <= KNOWN_WORDS else counted
    return _dictionaries_of(kept, parts), known, frozenset(r["letter"] for r in letters)


def _asked_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word whose being known may matter for a text: its own and those of all its readings."""
    for pdf in frames:
        rows = []
        for h, t in zip(pdf["h"], pdf["t"], strict=True):
            words: set[str] = set()
            for sentence in _SENTENCE.split(t):
                if _NON_ASCII.search(sentence):
                    words.update(_WORD.findall(sentence))
                    for reading, _ in candidates(sentence, _every).values():
                        words.update(_WORD.findall(reading))
            rows += [(h, w) for w in words]
        yield pd.DataFrame(rows, columns=["h", "word"])


def _with_known(rows: DataFrame, model: Model) -> tuple[DataFrame, Callable[[], Callable[[list[str] | None], Reader]]]:
    """``rows`` with a text ``t`` and ``known``, the known words that may matter for it; null where all tasks have all of them. And what makes a task's reader, which takes a row's ``known``.

    Texts are met by their hash: two that share one get each other's words too, which are known words all the same.
    """
    dictionaries, known, alphabet = model
    everywhere = None if isinstance(known, DataFrame) else known
    sent = rows.sparkSession.sparkContext.broadcast((dictionaries, everywhere, alphabet))  # bounded by KNOWN_WORDS and DICT_BYTES

    def make() -> Callable[[list[str] | None], Reader]:
        dictionaries, words, alphabet = sent.value
        reader = Reader(dictionaries, words if words is not None else frozenset(), alphabet)

        def of(mine: list[str] | None) -> Reader:
            if words is None:
                reader.knows(frozenset(() if mine is None else mine))
            return reader

        return of

    if everywhere is not None:
        return skew.spread(rows.withColumn("known", F.lit(None).cast("array<string>"))), make
    rows = rows.withColumn("h", F.xxhash64("t"))
    asked = skew.spread(rows.select("h", "t")).mapInPandas(_asked_words, "h long, word string").distinct()
    met = asked.join(known, "word").groupBy("h").agg(F.collect_set("word").alias("known"))
    return rows.join(met, "h", "left").drop("h"), make


def trained(passages: DataFrame, key: str, text: str, book: str | None = None) -> Model:
    """Train on a table. Words, letters and both rounds of leaving out go over all passages, in parallel, and all sentences train the dictionaries; the driver gets these and the words beyond ASCII that three passages hold. With ``book``, a word and its reading are compared by the books that hold them, so that one large book outvotes no others. The model doesn't depend on ``key``, nor on how the rows are spread but for which part takes a repeated passage."""
    rows = passages.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"), F.col(book).cast("string").alias("book") if book else F.lit(None).cast("string").alias("book"))
    rows = storage.staged(skew.spread(rows).mapInPandas(_scanned, "row long, t string, book string, words array<string>, letters array<string>, impossible boolean, languages array<string>"), "passages")
    # Without a book a passage stands for itself.
    by = rows.select(F.explode("words").alias("word"), F.coalesce(F.concat(F.lit("b"), "book"), F.col("row").cast("string")).alias("book")).distinct()
    words = storage.staged(by.groupBy("word").agg(F.count("*").alias("n")), "words")
    readings = skew.spread(words.where("length(word) > 2")).mapInPandas(_word_readings, "word string, n long, reading string")
    doubtful = readings.join(words.select(F.col("word").alias("reading"), F.col("n").alias("m")), "reading").where("m > n").select("word").distinct()
    left_out = rows.select("row", F.explode("words").alias("word")).join(doubtful, "word", "left_semi").select("row").distinct()
    kept = rows.where(~F.col("impossible")).join(storage.staged(left_out, "left_out"), "row", "left_anti")
    parts = _parts(rows)
    model = _model(kept, parts)

    texts, make = _with_known(kept.where(F.size("words") > 0).select("row", "t"), model)

    def garbled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for pdf in frames:
            yield pdf.loc[[bool(reader(known).passage(t)[1]) for t, known in zip(pdf["t"], pdf["known"], strict=True)], ["row"]]

    found = storage.staged(texts.mapInPandas(garbled, "row long"), "garbled")
    return _model(kept.join(found, "row", "left_anti"), parts)


def restored(passages: DataFrame, key: Column, text: Column, model: Model) -> DataFrame:
    """(key, text, chains): every passage that isn't null, with its text put back where nothing was lost and the chains that were undone.

    Null texts give no row; an empty text stays; repeated rows give repeated results.
    """
    rows, make = _with_known(passages.select(key.cast("string").alias("key"), text.alias("t")).where("t is not null"), model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for pdf in frames:
            results = [reader(known).passage(t) for t, known in zip(pdf["t"], pdf["known"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "text": [r[0] for r in results], "chains": [r[1] for r in results]})

    return rows.mapInPandas(run, "key string, text string, chains array<string>")
