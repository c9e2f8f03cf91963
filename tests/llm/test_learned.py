"""Packing, extraction, the two classifiers and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medstrand.llm import extraction, packing, quality, queries, toxicity
from tests.llm.conftest import prose

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

SPECIAL = ["", " ", "a", " a", "a  b", "a\n\nb", "it's  ok ", "x y", "tab\tb", "日本 語 ", "<|endoftext|> x", "a \n b", "é ü", "1 22 333", "\x1c \x1d"]


@pytest.fixture(scope="module")
def reference():
    one = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: one.encode(text, add_special_tokens=False).ids


def test_chunks_give_the_vocabularys_ids(reference, spark, sf):
    encoder = packing.ChunkEncoder(*queries.tokenizer_files())
    texts = SPECIAL + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts:
        assert np.frombuffer(encoder.encode(text or ""), dtype="<u4").tolist() == reference(text or ""), repr(text)[:80]


END = "<|endoftext|>"
ADDED = [END, END + END, f"a{END}", f"a {END} b", f"{END} b", f"a  {END}\n", f" {END} ", "<|endoftext|", f"<|{END}|>", f"x\n\n{END}\n é {END}"]


def test_added_tokens_keep_their_ids(reference, make):
    encoder = packing.ChunkEncoder(*queries.tokenizer_files())
    for text in ADDED:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == reference(text), repr(text)
    assert reference(END) == [50256]
    texts = list(enumerate(ADDED)) + [(100, prose(3, 900) + END + prose(4, 900))]
    _, places = packing.pack_documents(make(texts), *queries.tokenizer_files())
    check_pieces(places.collect(), {i: [*reference(t), 0] for i, t in texts})


def test_ranks_have_no_gap_in_many_parts(spark):
    pieces = spark.range(60).select(F.col("id").alias("_row"), F.lit(0).alias("start"), F.when(F.col("id") < 50, 9).otherwise(4).cast("long").alias("length"))
    ranked = packing._ranked(pieces, {9: 50, 4: 10}).collect()
    assert sorted(r["_rank"] for r in ranked if r["length"] == 9) == list(range(50))
    assert sorted(r["_rank"] for r in ranked if r["length"] == 4) == list(range(10))


@pytest.mark.parametrize("seed", range(60))
def test_plans_fill_every_window(seed):
    dice = random.Random(seed)
    window = dice.choice([8, 16, 64, 1024])
    counts = {dice.randint(1, window): dice.randint(1, dice.choice([3, 50, 5000])) for _ in range(dice.randint(1, 40))}
    placed, used = {}, {}
    for source, first, last, cut, length, sequence, offset in packing.plan(counts, window):
        for rank in range(first, last + 1):
            placed.setdefault(sequence + rank - first, []).append((offset, length))
            used.setdefault((source, rank), []).append((cut, length))
    for pieces, whole in [(p, None) for p in placed.values()] + [(u, key[0]) for key, u in used.items()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == whole if whole else at == window or at & (at - 1) == 0
    assert len(used) == sum(counts.values())


def test_fill_comes_closest():
    dice = random.Random(3)
    for _ in range(200):
        counts = {dice.randint(1, 30): dice.randint(1, 3) for _ in range(dice.randint(1, 5))}
        capacity = dice.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, capacity)
        assert all(chosen[k] <= counts[k] for k in chosen)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def check_pieces(rows, ids):
    """Every id in one piece, checksums right, sequences gapless and full or a power of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for key, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            piece = np.array(ids[key][at : at + r["length"]], dtype="<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids[key]) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids[key])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_op3(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_pieces(queries.op3(spark, sf).collect(), {r["doc_id"]: [*reference(r["text"] or ""), 0] for r in docs})


def test_packing_of_odd_tables(odd, none, make, reference):
    _, places = packing.pack_documents(odd, *queries.tokenizer_files())
    rows = places.collect()
    assert len({r["_row"] for r in rows}) == 12
    assert packing.pack_documents(none, *queries.tokenizer_files())[1].count() == 0
    texts = [(i, prose(i, 3)) for i in range(200)] + [(i, None) for i in range(200, 900)]
    _, places = packing.pack_documents(make(texts), *queries.tokenizer_files())
    check_pieces(places.collect(), {i: [*reference(t or ""), 0] for i, t in texts})


PAGES = [
    ("<html><head><title>T</title></head><body><nav><a href='/a'>Menu</a></nav><article><h1>A &amp; B</h1><p>One<br>two <a>three</a>"
     "<p>Of.</p><div class='ad'>Buy</div><script>var a='</p>';</script><!-- <p>no</p> --></article><footer>f</footer>",
     "A & B\nOne two three\nOf."),
    ("<body><div id=cookie-notice>We use cookies for many things that are longer than a line of the text itself, see here.</div>"
     "<div class=content><h1>Head</h1><p>" + "word " * 30 + "</p><p>Short.</p><p class='share'>Share</p><p>" + "more " * 30 + "</p></div>"
     "<section class='comments'><p>" + "reader " * 40 + "</p></section></body>",
     "Head\n" + ("word " * 30).strip() + "\nShort.\n" + ("more " * 30).strip()),
    ("<article><header><h1>Title</h1></header><p>a\xa0 b\n c</p><aside>x</aside><form>f</form><section class=comments>"
     "<article class=comment><p>c</p></article></section><p>end", "Title\na b c\nend"),
    # Words of a class that article text has too; a short beginning and end of the block in which the text surges.
    ("<article><h1>T</h1><p class='legal'>On the law.</p><div class='form-factor'>Small.</div><p>" + "word " * 30 + "</p>"
     "<div class='ad-box'>Buy</div><p class='legal'><a href='/x'>Terms of use</a></p><p>e</p></article>",
     "T\nOn the law.\nSmall.\n" + ("word " * 30).strip() + "\ne"),
    ("<body><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul><div>Unmarked notice.</div><div><h1>On</h1><p>A.<p>B.<p>C.<p>D.<p>"
     + "word " * 40 + "<p class=legal>E.<p>F.<div class='form-factor'>G.</div><p>H.</div><div>&copy; us</div>",
     "On\nA.\nB.\nC.\nD.\n" + ("word " * 40).strip() + "\nE.\nF.\nG.\nH."),
    ("<div class=top>Log</div><p>Tip</p><p>x</p><p>y</p><h2>Title</h2><table><tr><td>" + "cell " * 60 + "</td></tr></table><p>z</p>"
     "<div class='sidebar-left'>" + "other " * 30 + "</div>", "y\nTitle\n" + ("cell " * 60).strip() + "\nz"),
    ("", ""), (None, ""), ("<p", ""), ("just text", "just text"), ("<nav>n</nav>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_op5(spark, sf):
    """The article of every page of the tables, read another way."""
    import html
    import re

    got = {r["page_id"]: r for r in queries.op5(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p|article)[^>]*>", inside)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
        # Surge and dive find the same text where no element names it.
        unnamed = re.sub(r"(</?)article\b", r"\1div", r["html"])
        assert extraction.main_text(unnamed) == got[r["page_id"]]["text"]


def test_extraction_of_odd_tables(spark):
    schema = "page_id long, url string, html string, text string"
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0
    data = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a" + " b" * 300_000, "y")]
    assert sorted(len(r["text"]) for r in extraction.extract(spark.createDataFrame(data, schema)).collect()) == [0, 0, 600_001]


@pytest.fixture(scope="module")
def labelled(spark, make):
    """Texts with one of three words are toxic; texts of signs are bad."""
    docs, labels = [], []
    for i in range(900):
        text = prose(i, 40 + i % 50)
        toxic, good = int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            text += " you " + ("zounds", "fiend", "knave")[i % 3] + " " + prose(i + 5000, 5)
        if not good:
            text = text.replace(" ", "%%% ")
        docs.append((i, text))
        labels.append((i, good, toxic, "x"))
    docs += [(None, None), (5000, ""), (5001, None), (5001, None)]
    labels += [(None, 1, 1, "x"), (5000, None, None, "x"), (3, 1, None, "x")]
    return make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def held(scored, truth, bound):
    rows = [r for r in scored.collect() if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    return sum((r["score"] >= bound) == truth(r["doc_id"]) for r in rows) / len(rows)


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == 904 and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert held(scored, lambda i: i % 7 == 0, 0.3) > 0.97
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5001").count() == 2
    assert toxicity.reject(docs.limit(0), model).count() == 0
    # The whole row goes to Python once, its text within it.
    sent = toxicity.reject(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert sent.count("MapInArrow") == 1 and "AS __own" in sent and ", text#" not in sent.split("AS __own")[1].split("\n")[0]
    slices = toxicity.features(docs.coalesce(1), model.odds, ["doc_id"])
    assert slices.count() == docs.count() > 2 * toxicity.SLICE


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    found = quality.with_statistics(docs, ["doc_id"])
    ensemble = quality.fit(found, labels)
    assert 0 < len(ensemble.rules) + len(ensemble.linear) < 200
    scored = quality.score(found, ensemble)
    assert scored.count() == 904 and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert held(scored, lambda i: i % 5 != 0, 0.7) > 0.97


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_without_labels(labelled, operator):
    docs, labels = labelled
    docs = docs if operator is toxicity else quality.with_statistics(docs, ["doc_id"])
    one = labels.filter("quality = 1 and toxic = 0")
    for known in (labels.limit(0), one):
        scored = operator.score(docs, operator.fit(docs, known)).select("score").distinct().collect()
        assert len(scored) == 1 and 0 <= scored[0]["score"] <= 1


def test_rules_are_paths():
    tree = "\n".join(
        ["Forest", "  Tree 0 (weight 1.0):", "    If (feature 0 <= 1.5)", "     If (feature 2 > 3.0)", "      Predict: 1.0",
         "     Else (feature 2 <= 3.0)", "      Predict: 0.0", "    Else (feature 0 > 1.5)", "     Predict: 0.0"]
    )
    assert set(quality.rules_of(tree)) == {
        ((0, True, 1.5),), ((0, False, 1.5),), ((0, True, 1.5), (2, False, 3.0)), ((0, True, 1.5), (2, True, 3.0)),
    }


@pytest.mark.parametrize("name", ["op6_toxicity", "op8_quality"])
def test_scores_cover_the_table(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    bound = {"op6_toxicity": 0.3, "op8_quality": 0.7}[name]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bound)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= before.count()
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == before.count()


def test_pipeline_stages_on_odd_tables(spark, odd, none, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count() or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns


LONG = ("word " * 40).strip()


@pytest.mark.parametrize(
    "middle,text",
    [
        ("<ul>" + "".join(f"<li>item number {i}</li>" for i in range(9)) + "</ul>", "\n".join(f"item number {i}" for i in range(9))),
        ("<p>One.</p>" * 6 + "<p><a href='/x'>A paragraph that is one link</a></p>" + "<p>Two.</p>" * 6, "\n".join(["One."] * 6 + ["A paragraph that is one link"] + ["Two."] * 6)),
        ("<p><a name=here>Named.</p><p>" + "more " * 30 + "</p>", "Named.\n" + ("more " * 30).strip()),
        ("<p><a href=x>Open.</p><p>" + "more " * 30 + "</p>", "Open.\n" + ("more " * 30).strip()),
    ],
)
def test_short_lines_inside_the_text_stay(middle, text):
    """Pages without an article element against the same page with one."""
    parts = f"<p>{LONG}</p>{middle}<p>{LONG}</p>"
    menu = "".join(f"<p><a href='/{i}'>Menu {i}</a></p>" for i in range(5))
    plain = extraction.main_text(f"<body>{menu}<div>{parts}</div>{menu}</body>")
    assert plain == f"{LONG}\n{text}\n{LONG}" == extraction.main_text(f"<body>{menu}<article>{parts}</article>{menu}</body>")


def test_packing_keeps_few_chunks_at_hand():
    """A worker that earlier stages have used has little memory left: 100,000 chunks and no more."""
    path, pattern, added = queries.tokenizer_files()
    encoder = packing.ChunkEncoder(path, pattern, added)
    encoder.encode("a " + " ".join(f"{i:x}" for i in range(110_000)))
    encoder.encode("a b")
    assert 0 < len(encoder._kept) <= 100_000
