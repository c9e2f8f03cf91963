"""Chat formatting and sharding: round trips, laws and odd input."""

import hashlib

from pyspark.sql import functions as F

from medstrand.llm import chat, queries, sharding

NASTY = [
    "", "<", "[", "\\", "[INST]", "[\\INST]", "[\\\\INST] a [/INST]", "<<s>>", "</s>", "<</SYS>>x<<SYS>>", "<<TURN a>>b<</TURN>>",
    " [/INST", "<</s", "a\nb", "é[INST]ü", "[/INST] [INST] ", "<\\<SYS>>", " ", None, "x" * 50_000,
]
ROLES = ["user", "assistant", "system", None, "", "tool", "a>>b", ">", "<<TURN ", "[INST]", "é ü"]


def test_any_conversation_survives(spark):
    data = [(i, t, ROLES[(i * 7 + t) % len(ROLES)], NASTY[(i * 5 + t * 3 + t * t) % len(NASTY)]) for i in range(200) for t in range(i % 5 + 1)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted")))
    out = out.withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 200 and any(o["escaped"] for o in out) and not all(o["escaped"] for o in out)
    for o in out:
        source = [(r or "", x or "") for i, _, r, x in data if i == o["conv_id"]]
        assert [(t["role"], t["text"]) for t in o["turns"]] == source
        assert o["learned"] == "".join(x for r, x in source if r == "assistant")


def test_plain_text_stays_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "a [b] <c> \\d")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first()["formatted"] == "[INST] a [b] <c> \\d [/INST]"


def test_chat_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, escaped int"
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    data = [(None, None, None, None, "f", 1), (None, 1, "user", "b", "f", 1), (2, 1, "user", "x", "f", 1), (2, 1, "user", "x", "f", 1)]
    out = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(spark.createDataFrame(data, schema)).collect()}
    assert out == {None: "<<TURN >><</TURN>>[INST] b [/INST]", 2: "[INST] x [/INST][INST] x [/INST]"}


def test_op7(spark, sf):
    out = {r["conv_id"]: r for r in queries.op7(spark, sf).collect()}
    source = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    source[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(out) == set(source)
    for conv, turns in source.items():
        text = "".join(f"{a}\n{b}\n" for a, b in turns)
        learned = "".join(b for a, b in turns if a == "assistant")
        row = out[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_growth_moves_rows_into_the_new_shard_only(spark):
    old = sharding.tree(40)
    for layout in (old, sharding.grow(old)):
        moved = spark.range(20_000).select(
            sharding.shard_of(F.col("id"), layout).alias("a"), sharding.shard_of(F.col("id"), sharding.grow(layout)).alias("b")
        )
        new = 1 + max(r["a"] for r in moved.select("a").distinct().collect())
        assert moved.filter((F.col("a") != F.col("b")) & (F.col("b") != new)).count() == 0
        assert 300 < moved.filter(F.col("b") == new).count() < 700


def test_weights_confine_movement(spark):
    """A heavier shard takes rows; no row moves between two regions that kept their weights."""
    old = sharding.tree(16)
    new = {r: {k: {s: (3.0 if s == 0 else w) for s, w in leaves.items()} for k, leaves in racks.items()} for r, racks in old.items()}
    moved = spark.range(20_000).select(sharding.shard_of(F.col("id"), old).alias("a"), sharding.shard_of(F.col("id"), new).alias("b"))
    home = {s for leaves in old["region0"].values() for s in leaves}
    changed = moved.filter("a <> b").distinct().collect()
    assert changed and all(r["b"] in home for r in changed)
    share = moved.filter("b = 0").count() / 20_000
    assert 0.13 < share < 0.20  # 3 of 18


def test_slots_and_odd_rows(odd, none):
    out = sharding.assign(odd, sharding.tree(3)).collect()
    assert len(out) == 12
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in out if r["doc_id"] in (2, 3)} == {16} and {r["text_crc32"] for r in out if r["doc_id"] == 2} == {0}
    assert sharding.assign(none, sharding.tree(3)).count() == 0


def test_no_python_in_native_plans(spark, sf):
    for name in ("op7_chat", "op10_sharding"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
