import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from orbweave.llm import bpe, decontaminate, html_extract, language_id, license_scan, queries, toxicity, url_filter
from orbweave.llm.html_pages import labelled_pages
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TRICKY = ["", None, " ", "a" * 30_000, "ab" * 5_000, "<|endoftext|>", "x<|endoftext|>y", "don't  we'll\n\n x", "é\u00a0è\u2003 ñ", "日本語 текст", "a   b \t\n c", "12345 1a2b", "\x1c \x85", "😀😀", "\ud7ff\x00 z"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- BPE ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())


@pytest.fixture(scope="module")
def transducer():
    return bpe.Transducer(bpe.Vocabulary.load(queries.vocabulary_path()))


def test_bpe_query_equals_library(table, library):
    rows = list(enumerate(TRICKY))
    for r in bpe.encode_decode(table(rows), queries.vocabulary_path(), keep=True).collect():
        ids = library.encode(rows[r["doc_id"]][1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), text)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(table([]), queries.vocabulary_path()).count() == 0


def ids_of(transducer, text):
    return np.frombuffer(b"".join(transducer.encode(text)), "<u4").tolist()


def test_bpe_fuzz(library, transducer, monkeypatch):
    r = random.Random(1)
    letters = "abcdetheé ñ\n\t 12'slaб中😀<|endoftext|>"
    for k in range(1500):
        monkeypatch.setattr(bpe, "CHUNK", 1 << 16 if k % 2 else 7)
        text = "".join(r.choice(letters) for _ in range(r.randrange(60)))
        assert ids_of(transducer, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_streams_long_pieces_in_chunks(library, transducer, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    r = random.Random(2)
    for n in (100, 1_000, 5_000):
        for letters in ("abcthein", "a", "the ".strip()):
            piece = "".join(r.choice(letters) for _ in range(n))
            data = piece.encode()
            parts = list(transducer.stream(data[k : k + 64] for k in range(0, len(data), 64)))
            assert [i for p in parts for i in p] == library.encode(piece, add_special_tokens=False).ids
            if n > 2_000:  # what is held back is bounded
                assert len(parts) > 3 and max(sum(len(transducer.vocab.bytes[i]) for i in p) for p in parts) <= transducer.lookahead + 2 * transducer.longest + 64


def small_vocabulary(r):
    letters, tokens, merges = "ab", ["a", "b"], []
    for _ in range(r.randrange(1, 9)):
        x, y = r.choice(tokens), r.choice(tokens)
        if x + y not in tokens:
            tokens.append(x + y)
            merges.append(f"{x} {y}")
    return bpe.Vocabulary({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}}), letters


def test_bpe_lookahead_suffices_exhaustively():
    import itertools

    r = random.Random(12)
    for _ in range(25):
        vocab, letters = small_vocabulary(r)
        bound, stream = bpe.sufficient_lookahead(vocab), bpe.Transducer(vocab)
        known = {t: vocab.merge_all(t) for n in range(1, 11) for t in (bytes(x) for x in itertools.product(letters.encode(), repeat=n))}
        for text, ids in known.items():
            assert [i for p in stream.stream([text]) for i in p] == ids
            for cut in range(1, len(text)):
                end, settled = 0, []
                for i in known[text[:cut]]:
                    end += len(vocab.bytes[i])
                    if end > cut - bound:
                        break
                    settled.append(i)
                assert ids[: len(settled)] == settled


def test_bpe_pairs_and_decoder(transducer):
    r, vocab = random.Random(3), transducer.vocab
    tokens = [i for i in vocab.bytes if i not in vocab.special.values()]
    for _ in range(2000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert transducer.stable_pair(a, b) == (vocab.merge_all(vocab.bytes[a] + vocab.bytes[b]) == [a, b])
    one = bpe.Decoder(vocab)
    packed = np.array([vocab.ids[b"\xc3"], vocab.ids[b"\xa9"], vocab.ids[b"\xff"], vocab.ids[b"\xc3"]], "<u4").tobytes()
    assert "".join(one.decode(packed[k : k + 4] for k in range(0, len(packed), 4))) == b"\xc3\xa9\xff\xc3".decode(errors="replace")


# --- decontamination ---------------------------------------------------------


def brute_hits(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = WORD.findall(low(text))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    for d, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[tuple(w[i : i + size])]
        out[d] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return out


@pytest.mark.parametrize("hot, bits", [(1_000, 25), (0, 19)])
def test_decontamination_equals_brute_force(table, spark, monkeypatch, hot, bits):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", hot)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    r = random.Random(7)
    make = lambda n, size: " ".join(f"v{r.randrange(size)}" for _ in range(n))
    items = [(1, make(15, 9)), (2, "Ab, cd"), (10, make(12, 3)), (3, None), (4, ""), (5, make(15, 9)), (6, "ab cd")]
    docs = [(i, make(r.randrange(60), 3)) for i in range(20)] + [(30, "x " + items[0][1].upper() + "; y"), (31, None), (32, "AB.cd ab cd"), (33, "éab cd"), (34, (items[4 - 2][1] or "") * 3)]
    found = decontaminate.find_contamination(table(docs), spark.createDataFrame(items, "item_id long, text string"))
    out = {x["doc_id"]: tuple(x)[1:5] for x in decontaminate.digest(found).collect()}
    assert out == brute_hits(docs, items)


def test_decontamination_items_without_id(table, spark):
    items = [(None, "q r s"), (None, "t u"), (1, "q r s"), (2, "x y")]
    found = decontaminate.find_contamination(table([(1, "a t u b q r s"), (2, "t u"), (3, "x y"), (4, "z")]), spark.createDataFrame(items, "item_id long, text string"))
    out = {x["doc_id"]: tuple(x)[2:] for x in decontaminate.digest(found).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out == {1: (5, 2, sha("1"), True), 2: (2, 1, sha(""), True), 3: (2, 1, sha("2"), True), 4: (0, 0, sha(""), False)}


def test_decontamination_empty_sides(table, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.digest(decontaminate.find_contamination(table([(1, "a b")]), none)).collect()] == [(2, 0, 0)]
    assert decontaminate.find_contamination(table([]), none).count() == 0


# --- licenses ----------------------------------------------------------------


def test_license_base_equals_brute_force(table):
    r = random.Random(8)
    pool = "gnu general public license apache cc by mit x y".split()
    docs = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(60)))) for i in range(40)] + [(90, None), (91, ""), (92, "...MIT-License, mit license!"), (93, "CC\nBY 4.0"), (94, "gnu gnu general public license"), (95, "mitlicense mit é license")]
    out = {x["doc_id"]: x for x in license_scan.digest(license_scan.scan(table(docs))).collect()}
    assert len(out) == len(docs)
    for d, text in docs:
        w, places, labels = WORD.findall(low(text)), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        got = out[d]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1


def brute_license(text):
    """(labels, score) by the definition: places of word pairs, diagonals, bands,
    the longest ascending sequence of places."""
    w, labels, score = WORD.findall(low(text)), set(), 0.0
    for label, words, base in [(v, k.split(), True) for k, v in license_scan.PHRASES.items()] + [(v, k.split(), False) for v, k in license_scan.NOTICES]:
        diagonals = {}
        for p in range(len(w) - 1):
            for t in range(len(words) - 1):
                if w[p : p + 2] == words[t : t + 2]:
                    diagonals.setdefault(p - t, []).append((p, t))
        bands = []
        for d in sorted(diagonals):
            v = diagonals[d]
            if bands and not base and d - bands[-1][0] <= license_scan.GAP and min(v)[0] - bands[-1][1] <= license_scan.GAP + 1:
                bands[-1] = (d, max(v)[0], bands[-1][2] + v)
            else:
                bands.append((d, max(v)[0], list(v)))
        for _, _, v in bands:
            best = {}
            for p, t in sorted(v):
                best[p, t] = 1 + max((n for (a, b), n in best.items() if a < p and b < t), default=0)
            cover = max(best.values()) / (len(words) - 1)
            if cover >= (1.0 if base else license_scan.COVER):
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_license_labels_equal_brute_force(table):
    r = random.Random(18)
    texts = ["all rights all rights", "all rights reserved", "rights reserved all rights", "licensed under cc by", "licensed licensed under cc by 4 0 0", None]
    for _, notice in license_scan.NOTICES:
        for _ in range(4):
            w = notice.split()
            for _ in range(r.randrange(7)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(3)] = r.choice([[], ["x"], ["x", "y"], [r.choice(w)], w[k : k + 2] * 2])
                w = w or ["x"]
            texts.append(" ".join(["x"] * r.randrange(3) + w + notice.split()[: r.randrange(4)]))
    texts.append("all rights reserved all rights x reserved " * 40)
    out = {x["doc_id"]: (x["labels"], round(x["score"], 9)) for x in license_scan.digest(license_scan.scan(table(list(enumerate(texts))))).collect()}
    assert out[0] == ("", 0.0) and out == {i: (a, round(b, 9)) for i, (a, b) in ((i, brute_license(t)) for i, t in enumerate(texts))}


def test_license_spans_survive_edits(table):
    notice = dict((b, a) for a, b in license_scan.NOTICES)
    bsd = next(t for t, label in notice.items() if label == "bsd")
    w = bsd.split()
    edited = " ".join(w[:5] + ["really"] + w[5:12] + w[13:])
    out = {x["doc_id"]: x for x in license_scan.digest(license_scan.scan(table([(1, "start " + edited + " end"), (2, " ".join(w[:6])), (3, "plain text")]))).collect()}
    assert out[1]["labels"] == "bsd" and out[2]["labels"] == "" and out[3]["score"] == 0


# --- URLs --------------------------------------------------------------------


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = low(host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))[1:]


def test_urls_equal_brute_force(spark, table):
    hosts = ["a.Example.COM", "example.com", "notexample.com", "x.net", "example.net", "y.example.net", "q.org", "com", "", "a.cheap-pills.example.org", "pillsbury.example.io", "a-poker.io"]
    paths = ["/en/7", "/en/71?x=/de/", "/de/8#y", "/de/", "/es/", "/ES/", "", "/en", "?/en/", "/en/8\n"]
    rows = list(enumerate([f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "://com/en/", "a://b://com/en/"]))
    out = {r["page_id"]: r for r in url_filter.judge(table(rows, "page_id long, url string"), url_filter.rules_frame(spark)).collect()}
    for i, url in rows:
        host, path, (rule, verdict) = brute_rule(url, url_filter.RULES)
        own = "block" if {"pills", "poker"} & set(re.split("[.-]", host)) else "allow"
        assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == (host, path, rule, verdict or own), url


def test_url_filter_has_no_false_negatives(spark, table):
    rules = [("block", f"h{i}.org", f"/{i}/") for i in range(300)]
    rows = [(i, f"http://www.h{i}.org/{i}/z") for i in range(300)]
    out = url_filter.judge(table(rows, "page_id long, url string"), url_filter.rules_frame(spark, rules), blocks=4).collect()
    assert {r["rule"] for r in out} == {f"h{i}.org/{i}/" for i in range(300)}
    assert {r["verdict"] for r in url_filter.judge(table(rows, "page_id long, url string"), url_filter.rules_frame(spark, [])).collect()} == {"allow"}


# --- pages -------------------------------------------------------------------


def test_html_extracts_articles():
    model = html_extract.fit()
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; news</h1><p>First&nbsp; para<br>graph with <b>bold</b> text.<p>Second one, with a <a href=x>link</a> inside.
    <form><input name=q><select><option>One</select></form><!-- no --></article><aside class="sidebar">Other things.</aside><section class="comments"><p>Nice post, thanks!</p></section><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page, model).split("\n\n") == ["Big & news", "First para graph with bold text.", "Second one, with a link inside."]
    assert html_extract.main_text("", model) == "" and html_extract.main_text("just words & more", model) == "just words & more"


def test_html_held_out_labels():
    model, good, total = html_extract.fit(), 0, 0
    for page in labelled_pages(80, seed=99):
        nodes = html_extract.parse(page)
        for node, p in zip(nodes, model.marginals(nodes)):
            if node.tag == "#text" and nodes[node.parent].label >= 0:
                total += 1
                good += (p >= 0.5) == bool(nodes[node.parent].label)
    assert good / total > 0.93


def test_html_messages_equal_enumeration():
    import itertools

    model = html_extract.fit()
    nodes = html_extract.parse("<body><div class=ad><p>x</p></div><p>Some text here.</p></body>")
    unary = [sum(model.odds.get(f, 0) for f in fs) for fs in html_extract.node_features(nodes)]
    weights = np.zeros((len(nodes), 2))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        if not labels[0]:
            continue
        p = np.prod([1 / (1 + np.exp(-u if y else u)) for u, y in zip(unary, labels)])
        for i, node in enumerate(nodes[1:], 1):
            p *= model.pairs[html_extract._relation(nodes, node)][labels[node.parent]][labels[i]]
        for i, y in enumerate(labels):
            weights[i, y] += p
    assert np.allclose(model.marginals(nodes), weights[:, 1] / weights.sum(axis=1))


def test_html_table(table):
    rows = [(1, "u", "<p>One long enough paragraph of text, with marks.</p>"), (2, None, None), (3, "v", "<p>open <b>tag" + "<div>" * 2000)]
    out = {r["page_id"]: r for r in html_extract.extract(table(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"].startswith("One long") and out[1]["n_chars"] == len(out[1]["text"]) and (out[2]["text"], out[2]["n_chars"]) == ("", 0) and len(out) == 3


# --- classifiers -------------------------------------------------------------


def test_language_held_out_accuracy(table):
    r = random.Random(9)
    parts = {"aa": "the ing er tion and of", "bb": "sch ung der ei zu ber", "cc": "eau oi que ent les ai"}
    make = lambda lang, n: " ".join("".join(r.choice(parts[lang].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, r.randrange(3, 40)), lang if i % 10 else None) for i, lang in enumerate(list(parts) * 60)]
    rows += [(900, None, "aa"), (901, "123 !", "bb"), (902, "ЖЖЖ", None), (903, "", None), (None, make("aa", 9), None)]
    docs = table(rows, "doc_id long, text string, lang string")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    found = {x["doc_id"]: x for x in language_id.identify(docs, language_id.fit(docs, ~out)).collect()}
    truth = {i: list(parts)[i % 3] for i in range(180)}
    assert sum(found[i]["lang_pred"] == truth[i] for i in truth) / 180 > 0.95
    assert [found[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3 and found[902]["lang_pred"] in parts and found[902]["score"] == 0
    assert all(0 <= x["score"] <= 1 for x in found.values()) and len(found) == len(rows)
    nothing = language_id.fit(docs.where("false"), ~out)
    assert {x["lang_pred"] for x in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_equals_exact_counting(table):
    r = random.Random(19)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(1, 9)))
    kinds = {"aa": "abcdef", "bb": "cdefgh", "cc": "efghàé"}
    rows = [(i, " ".join(word(kinds[k]) + r.choice(["", ".", "1"]) for _ in range(r.randrange(1, 40))), k) for i, k in enumerate(list(kinds) * 40)]
    rows += [(5, "hhh ggg hhh", "bb"), (5, "fff", None)]
    docs = table(rows, "doc_id long, text string, lang string")
    out = language_id.held_out(F.col("doc_id"), 3, 1)

    def parts(text):
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for n in language_id.ORDERS:
                for k in range(len(w) + 3 - n):
                    yield (" " + w + " ")[k : k + n]

    train = [x for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 3 != 1]
    known = {k: {g for x in train if x[2] == k for g in parts(x[1])} for k in kinds}
    right = total = 0
    for x in language_id.identify(docs, language_id.fit(docs, ~out)).collect():
        for text in {t for i, t, _ in rows if i == x["doc_id"]} if x["doc_id"] != 5 else ():
            hits = sorted((sum(g in known[k] for g in parts(text)), k) for k in kinds)
            if hits[-1][0] > hits[-2][0] + 1:
                total, right = total + 1, right + (hits[-1][1] == x["lang_pred"])
                assert abs(x["score"] - hits[-1][0] / sum(h for h, _ in hits)) < 0.02
    assert total > 60 and right == total


def test_language_filter_has_no_false_negatives():
    keys = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = language_id.Model([f"l{i}" for i in range(70)], {f"l{i}": keys[i * 50 : i * 50 + 50] for i in range(70)})
    for i in (0, 1, 63, 64, 69):
        mask = model.languages_of(keys[i * 50 : i * 50 + 50])[i // 64]
        assert ((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1)).all()


def test_toxicity_held_out(table, spark):
    r = random.Random(10)
    plain = [f"w{i}" for i in range(80)]
    bad = ["grumpfel" + s for s in ("ab", "cd", "ef", "gh")] + ["idiot", "scum"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        toxic = i % 5 == 0 or i % 7 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "w1")]
    docs, marks = table(rows), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")
    out = language_id.held_out(F.col("doc_id"), 5, 0)
    found = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, marks, ~out)).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    assert sum((found[i] >= 0.5) == bool(t) for i, t in labels) / len(labels) > 0.95
    assert found[1000] == found[1001] < 0.5
    one_class = toxicity.fit(docs, marks.where("toxic = 0"), ~out)
    assert {x["score"] for x in toxicity.score(docs, one_class).collect()} == {0.0}


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    knots, values = toxicity.isotonic(r.normal(size=300), (r.random(300) > 0.5).astype(float), np.ones(300))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
