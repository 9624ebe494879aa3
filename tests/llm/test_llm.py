"""The text operators: exact round trips, brute force, planted cases; nulls, empty and long texts, repeats, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import encoding, leakage, pii, tokenizer

FR = ["L’aîné répète que le dépôt était déjà abîmé.", "La façade paraît plus âgé après la fête.", "Voilà pourquoi l’échéance a été pesé à nouveau.", "Les 12 cahiers étaient rangés près de la porte.", "Une feuille volée coûte trop cher pendant l’été."]
DE = ["Der müde Träger gehört nicht hierher.", "Die größere Kiste mußte zurückgehen für drei Tage.", "Außerdem läßt sich der Schlüssel nicht schließen.", "Könnte es sein, daß die Überweisung fällt kaum auf?", "In Kea hieß es, die Währung wurde erst spät geöffnet."]
EN = ["The glaze was set aside at low water.", "See Kea: “the ledger came back twice”.", "The plaster — about 31 by 12 cm — was paid in two parts.", "Nobody could say why the north wall was entered in the wrong column."]
PT = ["NÃO ABRIR: a estação ficou às escuras.", "O pão da manhã não tem preço."]


# 1 ------------------------------------------------------------------------------------------------
def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(rng.choice([FR, FR, DE, DE, EN, PT])) for _ in range(4)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return encoding.train(corpus())


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "latin-1"), ("cp1252", "cp850"), ("utf-8", "iso8859-2"), ("utf-8", "cp1254"), ("iso8859-15", "mac_roman")])
def test_wrong_decodings_are_put_back(model, written, read):
    reader = encoding.Reader(*model)
    hit = whole = tried = 0
    for text in corpus(40, seed=9):
        try:
            bad = text.encode(written).decode(read)
        except UnicodeError:
            continue
        if bad == text:
            continue
        tried += 1
        got, chains = reader.passage(bad)
        hit += bool(chains)
        whole += got == text
    assert tried > 5 and hit == tried and whole >= 0.9 * tried


def test_chains_of_different_kinds(model):
    """A pair of one-byte encodings below utf-8 read wrongly, and utf-8 read two bytes at a time."""
    reader = encoding.Reader(*model)
    for text in [t for t in corpus(30, seed=5) if sum(ord(c) > 127 for c in t) > 4][:12]:
        mixed = text.encode("cp1252").decode("mac_roman").encode().decode("latin-1")
        assert reader.passage(mixed)[0] == text
        wide = text.encode().decode("gbk", "replace")
        assert reader.passage(wide)[1]
        assert encoding.undo_wide("s茅ance d鈥檕r", "gbk") == "séance d’or"


def test_pairs_that_read_alike_are_tried_once():
    every = list(encoding.candidates("brûlé"))
    assert len(every) == len({r for r, _ in encoding.candidates("brûlé").values()}) < 60


def test_twice_wrong_and_lost(model):
    reader = encoding.Reader(*model)
    twice = FR[0].encode().decode("cp1252", "surrogateescape").encode("utf-8", "surrogateescape").decode("latin-1")
    assert reader.passage(twice)[1]
    lost = FR[0].encode("latin-1", "ignore").decode("utf-8", "replace")
    assert reader.passage(lost) == (lost, ["lost"])


def test_clean_texts_stay(model):
    reader = encoding.Reader(*model)
    for text in [*corpus(60, seed=5), "±5 µm, 20 °C, ½ turn, £5", "Старый амбар стоял у воды.", "┌──┬──┐ │ ok │", "", "plain", "Καλημέρα", "해녀들은 새벽 5시에"]:
        assert reader.passage(text) == (text, [])


def test_restored_frame(spark, model):
    rows = [("a", FR[0]), ("a", FR[0]), ("b", FR[1].encode().decode("cp1252")), ("c", None), ("d", ""), ("e", EN[0] * 3000)]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("key", F.lit("clash"))
    got = sorted((r["key"], r["text"] == FR[1] or None, bool(r["chains"])) for r in encoding.restored(df, F.col("k"), F.col("text"), model).collect())
    assert got == [("a", None, False), ("a", None, False), ("b", True, True), ("d", None, False), ("e", None, False)]
    assert encoding.restored(df.limit(0), F.col("k"), F.col("text"), encoding.trained(df.limit(0), "k", "text")).count() == 0


def test_words_and_letters_are_counted_over_all_passages(spark, monkeypatch):
    texts = [*corpus(), *["Der Frühnebel über dem Köhlerhof blieb."] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    whole = encoding.trained(df, "k", "text")
    assert whole[1:] == encoding.train(texts)[1:]
    monkeypatch.setattr(encoding, "SAMPLE", 20)
    assert encoding.trained(df, "k", "text")[1:] == whole[1:]
    assert {"Frühnebel", "Köhlerhof"} <= whole[1]


def test_all_passages_train_the_dictionaries(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(6)) for _ in range(300)]
    rare = [f"The {words[i]} of the mill was at {words[i + 1]}." for i in range(0, 300, 2)]
    marked = ["The ledger of the mill was closed.".encode("utf-8-sig").decode("cp1252")] * 4
    texts = [*corpus(60), *[f"{s} It was the {i} of May." for i, s in enumerate(rare * 3)], *marked]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    held = lambda dictionaries: sum(w.encode() in dictionaries["en"] for w in words)
    whole = encoding.train(texts)
    assert encoding.trained(df, "k", "text") == encoding.trained(df.repartition(3, F.rand(2)), "k", "text") == whole and held(whole[0]) > 290
    assert "ï»¿The" not in whole[1] and encoding.even_bytes("ï»¿") not in whole[0]["en"]
    monkeypatch.setattr(encoding, "SAMPLE", 60)
    monkeypatch.setattr(encoding, "MERGED", 3)
    merged = encoding.trained(df, "k", "text")[0]
    assert merged.keys() == whole[0].keys() and held(merged) > 250
    # A long passage trains as well, and a long sentence in pieces; repeated passages spread over the parts.
    monkeypatch.setattr(encoding, "SAMPLE_CHARS", 200)
    long = " ".join(texts[60:-4])
    assert encoding.trained(spark.createDataFrame([(0, long)], "k long, text string"), "k", "text")[0] == encoding._dictionaries([long]) and held(encoding._dictionaries([long])) > 290
    assert "".join(encoding._pieces("a" * 450)) == "a" * 450 and len(encoding._blocks(long, encoding._languages(long), encoding.Counter())) > 50
    met = encoding.Counter()
    assert len({place % 8 for _ in range(100) for _, place, _ in encoding._blocks("again", ["other"], met)}) == 8


def test_more_known_words_than_are_sent_are_joined(spark, monkeypatch):
    texts = [*corpus(60), *[t.encode().decode("cp1252", "replace") for t in corpus(12, seed=9)], *[t.encode("cp1252", "replace").decode("mac_roman") for t in corpus(12, seed=8)], None, "", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("known", F.lit("clash"))
    rows = lambda: sorted(map(tuple, encoding.restored(df, F.col("k"), F.col("text"), encoding.trained(df, "k", "text")).collect()), key=str)
    sent = rows()
    monkeypatch.setattr(encoding, "KNOWN_WORDS", 3)
    assert not isinstance(encoding.trained(df, "k", "text")[1], frozenset)
    assert rows() == sent and sum(bool(r[2]) for r in sent) > 15


def test_a_large_garbled_book_outvotes_no_others(spark):
    utf8, single = "Die Kühlung blieb am Köhlerhof.", "Der Nußbaum stand am Mühlbach."
    hot = [("hot", x) for x in (utf8.encode().decode("cp1252"), single.encode("cp1252").decode("mac_roman")) for _ in range(60)]
    rows = [*hot, *[(f"b{i}", x) for i in range(4) for x in (utf8, single)], *[(f"c{i % 9}", t) for i, t in enumerate(corpus())]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, book string, text string")
    known = encoding.trained(df, "k", "text", "book")[1]
    assert {"Kühlung", "Köhlerhof", "Nußbaum", "Mühlbach"} <= known
    assert known.isdisjoint(w for _, t in hot for w in encoding._WORD.findall(t))
    assert "KÃ¼hlung" in encoding._doubtful({"KÃ¼hlung": 60, "Kühlung": 1})


# 8 ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library(spark, library):
    rng = random.Random(8)
    texts = [*corpus(20), "", " ", "\n\n  \t x", "<|endoftext|> it's we'll I'D", "a" * 5000, "ab" * 3000, "해녀 \U0001f469‍\U0001f3a8 é́   ​", "".join(rng.choice("abc ,.é\n0123") for _ in range(4000)), "x" + " " * 300 + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokenizer.encoded(df, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["ids"] == ([] if r["key"] == 99 else library.encode(texts[r["key"]], add_special_tokens=False).ids)


def test_remembering_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 3)
    e = tokenizer.Encoder(tokenizer.parse_ranks(tokenizer.read_ranks()))
    text = " ".join(f"word{i} thing{i % 3}" for i in range(50))
    assert e.encode(text) == library.encode(text, add_special_tokens=False).ids and len(e.seen) <= 3


# 9 ------------------------------------------------------------------------------------------------
WORDS = [a + b for a in "gla psal lec rel bal ast spi qui raf hin nic buo cor lun".split() for b in "ze tery tern iquary ance rolabe ndle re ter ge he y bel ette mer dan sto vil".split()]
FILL = "the ledger was read aloud near the east door and nobody could say why the parcel came back twice at low water".split()


def items(rng, n=12):
    return [(i, " ".join(f"In the {rng.choice(WORDS)} of Zan{rng.randrange(10**5)} {rng.choice(WORDS)} {rng.choice(WORDS)} with {rng.randrange(10, 999)} {rng.choice(WORDS)}." for _ in range(4))) for i in range(n)]


def brute(docs, held):
    out = set()
    for d, text in docs:
        dw = leakage.words(text or "")
        for i, t in held:
            iw = leakage.words(t)
            reach = len(iw) + len(iw) // 4 + 8
            best = 0
            for s in range(0, max(1, len(dw)), 1):
                part = dw[s : s + reach]
                row = [0] * (len(iw) + 1)
                for w in part:
                    new = [0]
                    for k, v in enumerate(iw):
                        new.append(row[k] + 1 if w == v else max(row[k + 1], new[k]))
                    row = new
                if row[-1] > best:
                    best = row[-1]
            if best >= 0.5 * len(iw):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    held = items(rng)
    filler = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    docs = [(i, filler(60)) for i in range(40)]
    disguise = [str.upper, lambda t: t.replace(" ", "\n> "), lambda t: t.replace("e", "é"), lambda t: "<b>" + t.replace(" ", "&nbsp;") + "</b>", lambda t: t.replace(" ", " ​"), lambda t: t.replace(" was ", " (so they say) was "), lambda t: " ".join(w if rng.random() > 0.12 else "rather" for w in t.split())]
    for k, f in enumerate(disguise):
        docs.append((100 + k, f"{filler(30)} {f(held[k][1])} {filler(30)}"))
    docs += [(200, filler(20) + " " + " ".join(held[8][1].split()[: int(0.7 * len(held[8][1].split()))])), (201, " ".join(held[9][1].split()[:8]) + filler(50)), (202, None), (203, ""), (204, filler(30_000) + held[10][1] + filler(30_000)), (205, docs[-1][1]), (206, items(random.Random(77), 1)[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    it = spark.createDataFrame([*held, (50, None), (51, ""), (52, "?!")], "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaks(df, F.col("doc_id"), F.col("text"), it, "item_id", "text").collect()}
    small = [d for d in docs if d[0] != 204]
    assert got == brute(small, held) | {(204, 10)}
    assert leakage.leaks(df, F.col("doc_id"), F.col("text"), it.limit(0), "item_id", "text").count() == 0
    assert leakage.leaks(df.limit(0), F.col("doc_id"), F.col("text"), it, "item_id", "text").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    held = items(rng)
    docs = [(i, held[i][1]) for i in range(6)] + [(9, " ".join(FILL))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(held, "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK", 9)
    monkeypatch.setattr(leakage, "COLUMNS", 2)
    assert {(r["doc"], r["item"]) for r in leakage.leaks(df, F.col("doc_id"), F.col("text"), it, "item_id", "text").collect()} == {(i, i) for i in range(6)}


def test_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        row = [0] * (len(a) + 1)
        for w in b:
            new = [0]
            for k, v in enumerate(a):
                new.append(row[k] + 1 if w == v else max(row[k + 1], new[k]))
            row = new
        bits: dict = {}
        for k, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << k
        assert leakage.common_subsequence(bits, len(a), b) == row[-1]


# 10 -----------------------------------------------------------------------------------------------
NAMES = pii.Names(frozenset({"tobin", "perrine", "alden", "käthe", "nicolò"}), frozenset({"lanyard", "o'tallan", "d'aubréac", "della vecchiarda", "von ellernfeld", "fairweather-moss"}))
PLACES = [
    ("email", "tobin.l+x@post.test"), ("email", "TOBIN_9@EXAMPLE.ORG"), ("email", "tobin (at) mail.example.net"), ("email", "tobin [at] mail [dot] example [dot] net"), ("email", "tobin @ post.test"), ("email", "tobin＠post．test"), ("email", "tоbin@pоst.test"), ("email", "tobin@po​st.test"), ("email", "tobin at post dot test"),
    ("phone", "+15065550141"), ("phone", "(506) 555-0141"), ("phone", "1-506-555-0141"), ("phone", "506.555.0141"), ("phone", "07700 900123"), ("phone", "01 99 00 12 34"), ("phone", "0033 1 99 00 12 34"), ("phone", "0199001234"), ("phone", "+49 30 23125 132"), ("phone", "(030) 23125-298"), ("phone", "0171 3920099"), ("phone", "055/0002153"), ("phone", "+39 055 000161"),
    ("phone", "５０６-５５５-０１４１"), ("phone", "506‑555‑0141"), ("phone", "five oh six five five five oh one four one"),
    ("id_number", "000-35-4796"), ("id_number", "193199974723298"), ("id_number", "2 80 19 99 467 916 99"), ("id_number", "GMBSTG75A12Z000H"), ("id_number", "tdzvgg50p18z000c"),
    ("address", "217 Vizanino Road"), ("address", "106A Norùra St."), ("address", "108 rue des Cetorus"), ("address", "137 bis, rue du Pelmiel"), ("address", "80, chemin du Riceùra"), ("address", "Via Stemon n. 12"), ("address", "vicolo Pelmonus, 5"), ("address", "Am Luzanettplatz 85"), ("address", "Noickweg 143b"), ("address", "Quiethstr. 7"),
    ("name", "Tobin Lanyard"), ("name", "TOBIN O'TALLAN"), ("name", "Tobin T. Lanyard"), ("name", "Perrine Alden d’Aubréac"), ("name", "Lanyard, Tobin"), ("name", "Della Vecchiarda, Nicolò"), ("name", "Käthe von Ellernfeld"), ("name", "Alden\nFairweather-Moss"),
]


@pytest.mark.parametrize("kind,shown", PLACES)
def test_places(kind, shown):
    for before, after in (("Écrire à ", " demain."), ("x: ", ""), ("Note (", ") here"), ("🙂 ", ", yes")):
        text = before + shown + after
        assert pii.places(text, NAMES) == [(len(before), len(before) + len(shown), kind)], (text, [(text[a:b], k) for a, b, k in pii.places(text, NAMES)])


@pytest.mark.parametrize("label", ["SIN", "Steuer-ID", "IdNr."])
def test_labelled_numbers(label):
    n = "097 362 164" if label == "SIN" else "00 595 106 963"
    text = f"The form gives {label} {n}, fine."
    assert [(text[a:b], k) for a, b, k in pii.places(text, NAMES)] == [(n, "id_number")]
    assert pii.places(f"Count {n} is fine.", NAMES) == []


@pytest.mark.parametrize(
    "text", ["Tracking 3721 9310 0921 left.", "Checksum 038-7833-676 did not match.", "Shelfmark 402-5-29840, folio 99r.", "lsn 11961956 came before lsn 17405044.", "Thanks @receiver2, see origin@{3} and v6.18.11.", "Ledger page 12, Church Street fresco.", "Lot 56 on the Long Quay holds 86 barrels.", "The total is C$ 60,945.50 as of 2026-01-21.", "ch_531350812708 failed with code 265.", "Window 21:24–14:28, 16 by 7 cm.", "A Via la città vecchia manca 7.", "Tobin went to Lanyard.", "@@ -235,7 +235,7 @@\n+++ b/hook.py", ""]
)
def test_no_places(text):
    assert pii.places(text, NAMES) == []


def test_frames_and_learning(spark):
    texts = ["Ask for Tobin Lanyard at the counter. SIN 097 362 164", "Ask for Lanyard, Alden at the counter.", "Hier Perrine d’Aubréac a repris le colis.", "Die Rechnung geht an Käthe von Ellernfeld.", "Tobin d’Aubréac · Perrine T. Lanyard", None, "", "word " * 20_000 + "Perrine Lanyard"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    names = pii.learn_names(df, F.col("text"))
    assert {"tobin", "alden", "perrine", "käthe"} <= names[0] and {"lanyard", "d'aubréac", "von ellernfeld"} <= names[1]
    got = {(r["key"], r["kind"], r["char_start"]) for r in pii.found_places(df, F.col("doc_id"), F.col("text"), names).collect()}
    assert got == {(0, "name", 8), (0, "id_number", 42), (1, "name", 8), (2, "name", 5), (3, "name", 21), (4, "name", 0), (4, "name", 18), (7, "name", 100_000)}
    red = {r["key"]: (r["text"], r["places"]) for r in pii.redacted(df, F.col("doc_id"), F.col("text"), names).collect()}
    assert red[0] == ("Ask for [NAME] at the counter. SIN [ID_NUMBER]", 2) and red[5] == (None, 0) and red[6] == ("", 0)
    assert pii.learn_names(df.limit(0), F.col("text")) == (frozenset(), frozenset())
    assert pii.found_places(df.limit(0), F.col("doc_id"), F.col("text"), names).count() == 0


def test_offsets_come_back():
    rng = random.Random(10)
    bits = ["a​b", "ｘ１", "tobin [at] post [dot] test", "–", "tоbin", "one two three four five six", "plain ", "é ", "🙂"]
    for _ in range(200):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(8))
        plain = pii.Plain(text)
        at = [plain.source(i) for i in range(len(plain.text) + 1)]
        assert at == sorted(at) and all(0 <= x <= len(text) for x in at) and plain.source(len(plain.text), end=True) == len(text.rstrip("​")) or text.endswith("​") or plain.source(len(plain.text), end=True) == len(text)


def test_rare_names_count_in_any_corpus_and_more_names_than_are_sent_are_joined(spark, monkeypatch):
    letters = "abcdefghij"
    family = lambda i: "Zor" + "".join(letters[int(d)] for d in f"{i:04d}")
    rows = [(i, f"Please ask for Perrine {family(i)} today.") for i in range(1200)]
    rows += [(5000 + i, f"Later Perrine {family(i)} and Perrine Unheard came.") for i in range(0, 1200, 100)] + [(9000, None), (9001, ""), (9002, "Later PERRINE\nZORAAAA came.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = pii.learn_names(df, F.col("text"))
    assert {family(i).lower() for i in range(1200)} <= names[1]
    found = lambda n: sorted(map(tuple, pii.found_places(df, F.col("doc_id"), F.col("text"), n).collect()))
    whole = found(names)
    assert {k for k, *_ in whole if k >= 5000} == {*range(5000, 6200, 100), 9002}
    red = sorted(map(tuple, pii.redacted(df, F.col("doc_id"), F.col("text"), names).collect()))
    monkeypatch.setattr(pii, "GAZETTEER", 10)
    many = pii.learn_names(df, F.col("text"))
    assert not isinstance(many, tuple) and found(many) == whole
    assert sorted(map(tuple, pii.redacted(df, F.col("doc_id"), F.col("text"), many).collect())) == red


@pytest.mark.parametrize("text,plain", [("marie AT quai.org", "marie@quai.org"), ("marie at quai [dot] org", "marie@quai.org"), ("x { at } quai.org", "x@quai.org"), ("marie\u00a0at\u00a0quai.org", "marie@quai.org"), ("five.one.two.three.four.six", "512346"), ("five five five five five five", "555555")])
def test_every_disguise_of_the_patterns_is_tried(text, plain):
    assert pii.Plain(text).text == plain


@pytest.mark.parametrize("text,kind,shown", [("write to tobin at post.test now", "email", "tobin at post.test"), ("so tobin (  at ) post.test it is", "email", "tobin (  at ) post.test"), ("so tobin at\npost dot test", "email", "tobin at\npost dot test"), ("mail tobin@post&#46;test", "email", "tobin@post&#46;test"), ("mail tobin&#x40;post&period;test", "email", "tobin&#x40;post&period;test"), ("then Tobin  Lanyard came", "name", "Tobin  Lanyard"), ("then Tobin\tLanyard came", "name", "Tobin\tLanyard"), ("as 'Tobin Lanyard' says", "name", "Tobin Lanyard"), ("and so-called -Tobin Lanyard", "name", "Tobin Lanyard"), ("call five.oh.six.five.five.five.one.two.three.four", "phone", "five.oh.six.five.five.five.one.two.three.four")])
def test_more_disguises(text, kind, shown):
    assert [(text[a:b], k) for a, b, k in pii.places(text, NAMES)] == [(shown, kind)]


@pytest.mark.parametrize("text", ["look at example.com for more", "we met at post. Then", "arrived at noon. Bring it"])
def test_places_that_are_met_at(text):
    assert pii.places(text, NAMES) == []


def test_persons_are_announced_in_many_ways(spark):
    ways = ["Yesterday {} wrote to us.", "Best regards, {}", "Regards,\n{}", "My name is {} and I wait.", "{} called about the invoice.", "It was late. {} asked for it.", "Ich heiße {} und warte.", "Mi chiamo {} e aspetto.", "Je m’appelle {}.", "Me llamo {}.", "Left with {}, as agreed.", "A note prepared by {}."]
    letters = "abcdefghij"
    person = lambda i: f"Vel{letters[i % 10]}{letters[i // 10]} Quon{letters[i // 10]}{letters[i % 10]}d"
    df = spark.createDataFrame([(i, w.format(person(i))) for i, w in enumerate(ways)], "i long, t string")
    got = {(r["key"], r["char_start"], r["char_end"]) for r in pii.found_places(df, F.col("i"), F.col("t"), pii.learn_names(df, F.col("t"))).collect()}
    assert got == {(i, w.index("{"), w.index("{") + len(person(i))) for i, w in enumerate(ways)}
