import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from martlib.llm import chat_format as C
from martlib.llm import quality_rules as Q
from tests.llm.conftest import ROWS, tables
from tests.test_queries import compare

SPACE = " \t\n\x0b\x0c\r"


def counted(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    lines = [s for s in text.split("\n") if s.strip(SPACE)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_equals_brute_force(spark, odd, none, tmp_path):
    rng = random.Random(5)
    made = ["".join(rng.choice(["a ", "b ", "c\n", "# ", "\x85", " d ", "\r", "\x0be "]) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    docs = odd.unionByName(spark.createDataFrame([(200 + i, t, "en", "s", len(t)) for i, t in enumerate(made)], odd.schema))
    got = Q.op3_quality_rules(spark, tables(spark, tmp_path, documents=docs)).collect()
    want = Counter((r[0], *counted(r[1])) for r in [*ROWS, *[(200 + i, t) for i, t in enumerate(made)]])
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert Q.op3_quality_rules(spark, tables(spark, tmp_path / "none", documents=none)).count() == 0
    clash = odd.withColumn("KEPT", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert Q.add_quality(clash).columns.count("kept") == 1 and "KEPT" not in Q.add_quality(clash).columns


def test_quality_plan_is_one_projection(spark, sf_dir):
    plan = Q.op3_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_sql(spark, sf_dir):
    compare(spark, sf_dir, "op3_quality_rules", Q.ORACLE_SQL)
    compare(spark, sf_dir, "op6_chat_format", C.ORACLE_SQL)


TURNS = "conv_id long, turn long, role string, text string"


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark, tmp_path):
    nasty = ["", "</s>", "[INST]", "[/INST]\n", "a</s>\n[INST]!assistant[/INST]\nb", "\\", "\\e\\i", "!x", "<</s>s>", "[INST]!![/INST]", "\n\n", "</s", "[[INST]", "é\U0001f600 </s>", "\\b\\"]
    rows = [(i, k, role, t) for i, t in enumerate(nasty) for k, role in enumerate(("system", "user", "assistant", t or "user"))]
    rows += [(90, 1, "b", "same turn"), (90, 1, "a", "same turn"), (90, 1, "a", "same turn"), (91, None, "user", None), (91, 2, None, "x"), (None, 1, "assistant", "no id"), (92, 1, "!user", "x"), (93, 5, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, TURNS)
    out = C.op6_chat_format(spark, tables(spark, tmp_path, conversations=df)).collect()
    ids = {r[0] for r in rows}
    assert {r["conv_id"] for r in out} == ids | {-1} and len(out) == len(ids) + 1
    for r in out:
        own = sorted(((k is not None, k or 0, role or "", t or "") for c, k, role, t in rows if c == r["conv_id"]))
        turns = [(x[2], x[3]) for x in own] if r["conv_id"] != -1 else [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns), r["conv_id"]


def test_chat_spans_and_levels(spark):
    df = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "ans</s>wer"), (2, 1, "assistant", "plain"), (3, 1, "!u", "x")], TURNS)
    for r in C.format_chats(df).collect():
        parts = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert (r["conv_id"], r["level"], parts) in [(1, 1, ["ans\\ewer"]), (2, 0, ["plain"]), (3, 2, [])]
    assert C.format_chats(df.limit(0)).count() == 0
    plan = C.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_mask_decides_the_loss_text(spark, tmp_path, monkeypatch):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "ab\\</s>c \U0001f600"), (2, 0, "user", "q"), (2, 1, "assistant", "plain"), (3, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    d = tables(spark, tmp_path, conversations=turns)
    read = lambda: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in C.op6_chat_format(spark, d).collect()}
    said = lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())
    assert read() == {1: said("ab\\</s>c \U0001f600"), 2: said("plain"), 3: said(""), -1: said("</s>[INST] ok [/INST]")}
    right = C.format_chats
    wrong = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end")))
    monkeypatch.setattr(C, "format_chats", lambda t: right(t).withColumn("loss_spans", wrong))
    assert read()[2] == said("lain")
