"""The other operators against plain Python, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import brute
import pyarrow as pa
import pytest
from llm_edge import LONG, edge_rows
from pyspark.sql import functions as F

from guardlake.llm import language_id, license_scan, mixing, ngram_join, queries, sentencepiece_codec, token_counts, warc

SMALL = "/root/testdata/sf0.001"
RANKS = f"{queries.tokenizers()}/byte_bpe_50k.tiktoken"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# WARC ---------------------------------------------------------------------------------------------------------------------

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "http://a/1", "<p>é</p>"), (2, None, None), (3, "http://a/WARC/1.0", f"x{FAKE}y{FAKE}"), (4, "bad\r\nurl", "WARC/1.0\r\n"), (5, "u", "<p>é</p>"),
         (6, "u", ""), (-7, "u", f"x{FAKE}y{FAKE}"), (8, "u", "\r\n\r\nWARC/1.0\r\n\r\n\r\n"), (9, "u", "Z" * 9000), (9, "u2", "Z" * 9000), (None, "u", "Z" * 9000), (None, "u", "alone")]


@pytest.mark.parametrize("split", [None, "700"])
def test_warc_round_trip(spark, tmp_path, split):
    """Records come back whatever the splits, with payloads that hold magics and whole records."""
    pages = spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    path = f"file://{tmp_path}/w{split}"
    warc.write(pages, path)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = warc.records(spark, path, payloads=True).collect()
        facts = warc.pages_of(warc.records(spark, path)).collect()
        assert warc.unread(spark, path).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(records) == len(facts) == len(PAGES)
    least = {}
    for i, _, h in PAGES:
        least[h or ""] = min([x for x in (least.get(h or ""), i) if x is not None], default=None)
    want = sorted(((i, len((h or "").encode()), digest((h or "").encode()), "response" if i == least[h or ""] else "revisit", None if i == least[h or ""] else least[h or ""])
                   for i, _, h in PAGES), key=repr)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in facts), key=repr) == want
    responses = Counter(bytes(r["payload"]).decode() for r in records if "WARC-Type: response" in r["head"])
    assert set(responses) == {h or "" for _, _, h in PAGES} and responses["Z" * 9000] == 2
    assert all("%0D%0A" in r["head"] or "bad" not in r["head"] for r in records)


def test_warc_of_nothing_and_broken_files(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/none")
    assert warc.pages_of(warc.records(spark, f"file://{tmp_path}/none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.warc").write_bytes(b"junk" + FAKE.encode())
    (tmp_path / "bad/b.warc").write_bytes(FAKE.encode() + FAKE.replace("Length: 3", "Length: x").encode() + FAKE.encode())
    (tmp_path / "bad/c.warc").write_bytes(FAKE.encode() * 2)
    assert warc.records(spark, f"file://{tmp_path}/bad").count() == 3
    assert {r["file"][-6:] for r in warc.unread(spark, f"file://{tmp_path}/bad").collect()} == {"a.warc", "b.warc"}


def test_warc_minimum_for_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/m", least=3)
    got = warc.pages_of(warc.records(spark, f"file://{tmp_path}/m")).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


# Licenses -----------------------------------------------------------------------------------------------------------------

def test_licenses(spark, edge, empty):
    full = dict(license_scan.TEMPLATES)["Apache-2.0"]
    texts = [
        "Prose of some kind.\nReleased under the MIT License.\nMore prose é 😀.",
        "é\n" + full.replace("\n", "\n# ") + "\nrest",
        "é " + full.replace("file", "module") + " tail",
        "A licence to kill is not a notice at all, nor is this sentence.",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.",
        "nothing here"]
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].append(r)
    assert [(r["license"], r["exact"], texts[0][r["start"]:r["end"]]) for r in got[0]] == [("MIT", True, "Released under the MIT License")]
    assert [(r["license"], r["exact"]) for r in got[1]] == [("Apache-2.0", True)] and texts[1][got[1][0]["start"]:].startswith("Licensed under")
    assert [(r["license"], r["exact"], r["missing"], r["added"]) for r in got[2]] == [("Apache-2.0", False, 1, 1)]
    assert [r["license"] for r in got[3]] == [None]
    assert [r["license"] for r in got[4]] == ["CC-BY-NC-4.0", "CC-BY-SA-4.0"]
    assert 5 not in got
    assert [r["license"] for r in license_scan.scan(edge).collect()] == ["MIT"] and license_scan.scan(empty).count() == 0


def test_every_template_is_found_exactly(spark):
    rows = [(i, "Before it.\n" + t.replace(license_scan.ANY, "the Acme Group") + "\nAfter it.") for i, (_, t) in enumerate(license_scan.TEMPLATES)
            if re.search(license_scan.WORDS, t, re.I)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i]["license"] == license_scan.TEMPLATES[i][0] and got[i]["exact"] for i, _ in rows)


def test_licenses_come_from_compression(monkeypatch):
    apache = dict(license_scan.TEMPLATES)["Apache-2.0"]
    texts = ["x\nReleased under the MIT License.\ny", f"x\n{apache}\ny"]
    use = license_scan.Matcher(license_scan.TEMPLATES)
    assert [[use.names[hit[2]] for hit in use.found(t)] for t in texts] == [["MIT"], ["Apache-2.0"]]
    monkeypatch.setattr(license_scan.Matcher, "ranked", lambda self, words: [(0.0, i) for i in range(len(self.names))])
    assert [[hit[2] for hit in use.found(t)] for t in texts] == [[None], [None]]
    # a ranking that is upside down prefers what compresses least
    real = license_scan.Matcher(license_scan.TEMPLATES)
    monkeypatch.undo()
    both = f"x\nLicensed under the Apache License, Version 2.0 (the license)\n{apache}"
    assert [real.names[hit[2]] for hit in real.found(both)][-1] == "Apache-2.0"


def test_license_far_into_one_line(spark):
    """Notices are found however many words of the line stand before them, and far behind another."""
    apache = dict(license_scan.TEMPLATES)["Apache-2.0"].replace("\n", " ")
    notice = "Licensed under the MIT License."
    prose = " ".join(f"plain{i % 700} words" for i in range(1000))
    texts = [f"{prose} {notice} {prose}", f"{notice} {prose} {apache} {prose} {notice}", f"{prose} license of no kind {prose}"]
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start"], r["license"], r["exact"]))
    assert got[0] == [(len(prose) + 1, "MIT", True)]
    assert [x[1:] for x in sorted(got[1])] == [("MIT", True), ("Apache-2.0", True), ("MIT", True)]
    assert [x[1] for x in got[2]] == [None]


def test_license_short_above_long(spark):
    """A short notice before a longer one in the same block stays, and so do copies side by side."""
    long = {name: t for name, t in license_scan.TEMPLATES if len(t) > 200}
    short = {"CC-BY-4.0": "Licensed under CC BY 4.0.", "MIT": "Licensed under the MIT License."}
    pairs = [(a, b, sep) for a in short for b in long for sep in ("\n", " ")]
    rows = [(i, short[a] + sep + long[b].replace(license_scan.ANY, "Acme") + sep + short[a] + sep + short[a]) for i, (a, b, sep) in enumerate(pairs)]
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["start"], r["license"], r["exact"]))
    for i, (a, b, _) in enumerate(pairs):
        assert [x[1:] for x in sorted(got[i])] == [(a, True), (b, True), (a, True), (a, True)]


def test_license_amid_prose(spark):
    """Every one-line notice is found in prose on its own line, whatever the prose has in common with longer templates."""
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' AND n_chars > 4000").orderBy("doc_id").limit(12).collect()]
    short = [(name, t) for name, t in license_scan.TEMPLATES if len(t) < 90]
    rows, want = [], {}
    for text in prose:
        words = [w for w in text.split() if not re.search(license_scan.WORDS, w, re.I)]
        for name, t in short:
            for n in (30, 100, 150):
                want[len(rows)] = name
                rows.append((len(rows), " ".join([*words[:n], t, *words[n:2 * n]])))
    got = Counter((r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("exact").collect())
    assert got == Counter(want.items())


def test_license_lines_of_documents(docs):
    """The one-line notices that plain search finds, and no others."""
    lines = {t.strip(".").lower(): name for name, t in license_scan.TEMPLATES if len(t) < 90}
    want = Counter((r["doc_id"], name) for r in docs.collect() for t, name in lines.items() for _ in re.findall(re.escape(t), (r["text"] or "").lower()))
    got = Counter((r["doc_id"], r["license"]) for r in license_scan.scan(docs).filter("exact").collect())
    assert got == want


# SentencePiece ------------------------------------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark, docs, edge, empty):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=queries.piece_model())
    odd = ["Hello  world", " lead", "a\tb\nc\x00d", "é 😀 ▁x", "   ", "x   y ", " \n foo\n\nbar baz", " " * 37 + "x" + " " * 16, "a" * 40 + " bbbbb", " 　x"]
    more = spark.createDataFrame(list(enumerate(odd, 10_000)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), more, edge):
        texts = df.select("doc_id", "text").collect()
        got = sentencepiece_codec.encode(df, queries.piece_model()).collect()
        want = Counter((r["doc_id"], tuple(model.encode(r["text"] or ""))) for r in texts)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
        assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(more, queries.piece_model()), queries.piece_model()).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t.replace("▁", " ") for i, t in enumerate(odd, 10_000)}
    assert sentencepiece_codec.encode(empty, queries.piece_model()).count() == 0


def test_codec_after_forgetting(monkeypatch):
    """The same pieces when words and pairs are forgotten all the time."""
    monkeypatch.setattr(sentencepiece_codec, "WORDS", 3)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 5)
    codec = sentencepiece_codec.Codec(queries.piece_model())
    for text in ("some words of many", "other words of some kind", "", "words"):
        ids, starts = codec.encoded([text])
        assert codec.decoded(ids.tolist()) == text and starts[-1] == len(ids)


# Languages ----------------------------------------------------------------------------------------------------------------

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, edge, empty):
    got = language_id.report(edge, least=1).collect()
    assert len(got) == len(edge_rows())
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for i in (0, 1, 2) for r in by[i])
    assert not by[None][0]["held_out"] and {r["lang_pred"] for r in got} <= {"und", "en", "de"}
    assert language_id.report(empty).count() == 0
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.report(unlabelled).collect()} == {"und"}


def test_language_backoff():
    rows = [("a", 0, "known", 9), ("b", 0, "known", 1), ("b", 3, "unk", 5), ("a", 1, "u", 50), ("b", 1, "u", 2)]
    model = language_id.Model(*language_id.model_of(pa.table(dict(zip(("lang", "kind", "item", "n"), map(list, zip(*rows)))))))
    votes = model.votes_of(["known", "xunkx", "qu", "zzz"])
    assert [v.argmax() for v in votes[:3]] == [0, 1, 0] and (votes[3] == 0).all()


def test_language_learns_from_no_held_out_row(spark, edge):
    """Other labels on held-out rows change nothing."""
    twisted = edge.withColumn("lang", F.when(language_id.remainder(F.col("doc_id")) == 1, F.lit("xx")).otherwise(F.col("lang")))
    one, two = (sorted(map(tuple, language_id.report(x, least=1).collect()), key=repr) for x in (edge, twisted))
    assert one == two


def test_language_with_few_rows(spark):
    """A language with 0.01% of the rows is learned and predicted within small bounds, and keeps entries of its own."""
    rows = spark.range(300_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10_000 == 7, "rare").otherwise("major").alias("lang"))
    number = F.concat_ws(" ", *[F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(3000)).cast("string") for i in range(8)])
    docs = rows.withColumn("text", F.when(F.col("lang") == "rare", F.translate(number, "0123456789", "klmnopqrst")).otherwise(
        F.translate(number, "0123456789", "abcdefghij")))
    bounds = {"sample": 1000, "least": 1, "entries": 400}
    labelled = docs.filter((language_id.remainder(F.col("doc_id")) != 1)).select("doc_id", "text", "lang")
    kept = Counter((r["lang"], r["kind"]) for r in language_id.counts(labelled, **bounds).collect())
    assert all(kept["rare", kind] for kind in range(6)) and all(kept["major", kind] for kind in range(6))
    assert sum(n for (_, kind), n in kept.items() if kind == 0) <= 480 and sum(n for (_, kind), n in kept.items() if kind) <= 480
    got = language_id.predict(docs.filter("lang = 'rare' OR doc_id < 300").select("doc_id", "text"), language_id.train(docs, **bounds)).filter("held_out").collect()
    assert sum(r["doc_id"] % 10_000 == 7 for r in got) >= 5
    assert all(r["lang_pred"] == ("rare" if r["doc_id"] % 10_000 == 7 else "major") for r in got)


def test_parts_of_a_bound():
    assert [language_id.level(*x) for x in (([5, 100, 100], 105), ([1, 2], 10), ([], 5), ([10, 10], 7))] == [50, 2, 0, 3]


# Token counts -------------------------------------------------------------------------------------------------------------

def test_counts_after_random_edits(spark):
    """Counts, texts and trees after many edits equal a full count of the edited text."""
    rng = random.Random(5)
    counter = token_counts.Counter(RANKS, queries.PATTERN)
    rows = []
    for i, text in enumerate([None, "", "it's   don't  \n\n x", "aé😀" * 50, LONG[:9000], "word " * 3000, "'", "a" * 6000]):
        size, edits = len(text or ""), []
        for _ in range(25):
            at, remove = rng.randrange(-1, size + 3), rng.choice([0, 0, 1, 2, 5, 40, 600])
            insert = rng.choice(["", " ", "  \n", "'s", "x", "l", "re'", "12 34", "é", "many more words " * 20, "z" * 300])
            edits.append((at, remove, insert))
            size = max(size + len(insert) - min(remove, max(size - max(at, 0), 0)), 0)
        rows.append((i, text, edits))
    rows.append((99, "plain text", None))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {token_counts.EDITS}")
    trees = token_counts.build(df, RANKS, queries.PATTERN, "doc_id", "text", "edits")
    got = {r["doc_id"]: r for r in token_counts.recount(trees, RANKS, queries.PATTERN, text=True).collect()}
    for i, text, edits in rows:
        now = text or ""
        assert got[i]["tokens_before"] == len(counter.encoding.encode_ordinary(now))
        for at, remove, insert in edits or []:
            at = min(max(at, 0), len(now))
            now = now[:at] + insert + now[min(at + remove, len(now)):]
        assert got[i]["text"] == now and got[i]["tokens_after"] == len(counter.encoding.encode_ordinary(now))
        chars, tokens = got[i]["tree"]["chars"], got[i]["tree"]["tokens"]
        assert chars[1] == len(now) and all(x[k] == x[2 * k] + x[2 * k + 1] for x in (chars, tokens) for k in range(1, len(chars) // 2))


def test_counts_touch_little(spark, docs, edge, empty):
    got = queries.op8_token_counts(spark, SMALL).collect()
    sizes = {r["doc_id"]: len(r["text"] or "") for r in docs.collect()}
    assert len(got) == len(sizes) and all(r["chars_again"] < 1500 for r in got if sizes[r["doc_id"]] > 20_000)
    for df in (edge, empty):
        df = df.withColumn("edits", token_counts.revision(df["text"], df["doc_id"], df["source"]))
        trees = token_counts.build(df, RANKS, queries.PATTERN, "doc_id", "text", "edits")
        assert token_counts.recount(trees, RANKS, queries.PATTERN).count() == df.count()


# Mixing -------------------------------------------------------------------------------------------------------------------

def test_mix_meets_targets(spark, docs, edge, empty):
    for df in (docs, edge):
        got = mixing.report(df).collect()
        rows = df.select("doc_id", "source", "text").collect()
        sizes, classes = Counter(), Counter()
        for r in rows:
            sizes[r["source"]] += len(brute.words(r["text"]))
            classes[r["source"], len(brute.words(r["text"]))] += 1
        targets = brute.mix_targets(sizes)
        assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(
            (r["doc_id"], len(brute.words(r["text"]))) for r in rows if r["doc_id"] is not None)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        assert sorted({(r["source_size"], round(r["target"], 6)) for r in got}) == sorted({(sizes[s], round(t, 6)) for s, t in targets.items()})
        copies = {(r["source"], r["size"]): (r["n"], r["copies"]) for r in mixing.plan(df.select("source", mixing.words(df["text"]).alias("size")))[0].collect()}
        want = brute.mix_copies(classes, targets)
        assert set(copies) == set(want)
        for s in sizes:
            mine, plain = (sum(k[1] * c for k, c in x.items() if k[0] == s) for x in ({k: c for k, (_, c) in copies.items()}, want))
            assert abs(mine - plain) <= max([k[1] for k in want if k[0] == s], default=0) and abs(mine - targets[s]) <= max(
                [k[1] for k in want if k[0] == s], default=0)
    assert sorted(map(tuple, mixing.report(docs).collect())) == sorted(map(tuple, mixing.report(docs.repartition(5)).collect()))
    assert mixing.report(empty).count() == 0


def test_mix_rows_follow_the_report(edge, empty):
    mixed = mixing.mixed(edge)
    assert mixed.columns == edge.columns
    taken = Counter()
    for r in mixing.report(edge).collect():
        if r["size"]:
            taken[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +taken
    assert mixing.mixed(empty).count() == 0


def test_mix_takes_what_is_planned(spark):
    """The words taken of a source are those planned, also where doc_ids are null or repeated."""
    rows = [(i if i % 3 else None if i % 2 else 7, f"s{i % 4}", " ".join(["word"] * (20 + i % 2)) + (f" {i}" if i % 5 else " 0")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    planned, taken, mixed = Counter(), Counter(), Counter()
    for r in mixing.plan(df.select("source", mixing.words(df["text"]).alias("size")))[0].collect():
        planned[r["source"]] += r["size"] * r["copies"]
    for r in mixing.mixed(df).collect():
        mixed[r["source"]] += len(r["text"].split())
    for r in mixing.report(df).collect():
        taken[r["target"], r["source_size"]] += r["taken"]
    assert mixed == planned and sorted(taken.values()) == sorted(planned.values())
    assert all(abs(n - target) <= 22 for (target, _), n in taken.items())


# N-gram join --------------------------------------------------------------------------------------------------------------

def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.9999)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold ** rows) ** bands >= recall


def test_shingle_sets_are_as_plain():
    texts = [r[1] for r in edge_rows()] + ["a\x0bb\x0cc d e\x1cf g h", "  x y"]
    assert [len(s) for s in ngram_join.shingles(pa.array(texts))] == [len(brute.shingles(t)) for t in texts]


def _family(rng, size, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    while True:
        copy = list(base)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_join_equals_all_pairs(spark, monkeypatch):
    """Families of near copies, exact copies and strangers, with cells so small that groups are split."""
    monkeypatch.setattr(ngram_join, "CELL_CLASSES", 8)
    rng = random.Random(11)
    texts = [t for changes in (4, 4, 9, 14) for t, _ in zip(_family(rng, 200, changes), range(25))]
    texts += texts[:10] + ["a b c", "a b c", "", None, "one two three four five six"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.report(df).collect()}
    assert got == brute.near_groups(rows)
    stay = ngram_join.one_of_each(df)
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, (c, _) in got.items() if c == i)


def test_only_shared_band_hashes_shuffle_with_their_class(spark, monkeypatch):
    """Entries meet the counted band hashes after a filter; before, each of them shuffled with its class."""
    seen, tested = {}, ngram_join.bloom.tested

    def noted(rows, key, filter_):
        out = tested(rows, key, filter_)
        seen[key] = rows.count(), out.filter("maybe").count()
        return out

    monkeypatch.setattr(ngram_join.bloom, "tested", noted)
    rng = random.Random(5)
    texts = [next(_family(rng, 60, 1)) for _ in range(300)] + [t for t, _ in zip(_family(rng, 200, 4), range(5))]
    rows = list(enumerate(texts))
    got = ngram_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == brute.near_groups(rows)
    bands, _ = ngram_join.banding()
    entries, kept = seen["bucket"]
    assert entries == 305 * bands and 0 < kept <= 6 * bands


def test_bits_of_the_filter(spark):
    """The filter holds its keys, and few others."""
    keys = spark.range(4000).select((F.col("id") * 7919).alias("k"))
    held = ngram_join.bloom.tested(spark.range(40000).select((F.col("id") * 7919).alias("k")), "k", ngram_join.bloom.repeated(keys, "k", 4000, least=1))
    counts = {r["inside"]: (r["maybe"], r["n"]) for r in held.groupBy((F.col("k") < 4000 * 7919).alias("inside")).agg(
        F.count_if("maybe").alias("maybe"), F.count(F.lit(1)).alias("n")).collect()}
    assert counts[True] == (4000, 4000) and counts[False][0] < 0.02 * counts[False][1]


def test_join_of_documents(docs, edge, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.report(docs).collect()} == brute.near_groups(rows)
    assert ngram_join.report(edge).count() == len(edge_rows()) and ngram_join.report(empty).count() == 0
    stay = ngram_join.one_of_each(edge)
    assert stay.columns == edge.columns
    kept = [r["text"] for r in stay.collect()]
    assert len([t for t in kept if t == LONG]) == 1 and len([t for t in kept if t and t.startswith("Same text")]) == 1
    assert len([t for t in kept if not brute.words(t)]) == len([r for r in edge_rows() if not brute.words(r[1])])
    assert ngram_join.one_of_each(empty).count() == 0
