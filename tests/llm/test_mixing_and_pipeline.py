import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from martlib.llm import mixing as M
from tests.llm.conftest import ROWS, tables
from tests.test_queries import compare


def dealt(total, children):
    """Budgets of one family by filling up children until none overflows; children: {name: (cap, weight)}."""
    left, open_, out = total, dict(children), {}
    while open_:
        rest = sum(w for _, w in open_.values())
        full = {n for n, (cap, w) in open_.items() if cap * rest <= left * w}
        if not full:
            return out | {n: min(cap, left * w // rest) for n, (cap, w) in open_.items()}
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[n] = open_[n][0]
        left -= open_.pop(n)[0]
    return out


def mixed(rows, percent=M.BUDGET_PERCENT, epochs=M.MAX_EPOCHS, seed=M.SEED):
    leaves = defaultdict(list)
    for i, t, lang, source, _ in rows:
        source, lang = source or "", lang or ""
        digit = hashlib.md5(source.encode()).hexdigest()[0]
        leaves["web" if digit < "5" else "forum" if digit < "a" else "books", lang, source].append((i, -(-len((t or "").encode()) // 4)))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weights = (M.DOMAIN_WEIGHTS, M.LANG_WEIGHTS, M.SOURCE_WEIGHTS)
    budget = {(): sum(tokens.values()) * percent // 100}
    for level in range(3):
        for parent in [k for k in budget if len(k) == level]:
            names = {k[level] for k in leaves if k[:level] == parent}
            family = {n: (sum(tokens[k] * epochs for k in leaves if k[: level + 1] == (*parent, n)), weights[level].get(n, 1)) for n in names}
            budget |= {(*parent, n): b for n, b in dealt(budget[parent], family).items()}
    out = Counter()
    for leaf, docs in leaves.items():
        whole, rest = divmod(budget[leaf], tokens[leaf]) if tokens[leaf] else (epochs, 0)
        run = 0
        for i, n in sorted(docs, key=lambda d: (hashlib.md5(f"{seed}|{whole}|{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[0] is not None, d[0] or 0)):
            run += n
            copies = whole + (n > 0 and whole < epochs and run <= rest)
            if copies:
                out[(i, *leaf, n, copies)] += 1
    return out


def test_mix_equals_brute_force(spark):
    rows = [(i, "x" * (i * 37 % 400), ("en", "fr", "de", None)[i % 4], f"src{i * i % 7}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for epochs, percent in ((2, 60), (1, 60), (3, 250), (2, 0)):
        got = Counter(tuple(r) for r in M.mix(df, percent, epochs, slice_docs=4).select("doc_id", *M.LEVELS, "tokens", "copies").collect())
        assert got == mixed(rows, percent, epochs)


def test_mix_edge_cases(spark, odd, none):
    got = Counter(tuple(r) for r in M.mix(odd).select("doc_id", *M.LEVELS, "tokens", "copies").collect())
    assert got == mixed(ROWS)
    assert M.mix(none).count() == 0
    plan = M.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_sql(spark, sf_dir):
    compare(spark, sf_dir, "op10_mixing", M.ORACLE_SQL)


def near_copies_by_all_pairs(texts):
    """How many groups links of five-word shingle sets with a similarity of 0.8 or more leave."""
    sets = []
    for t in {" ".join((t or "").lower().split()) for t in texts}:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and find(i) != find(j) and len(a & b) >= 0.8 * len(a | b):
                up[find(i)] = find(j)
    return len({find(i) for i in range(len(sets))})


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "bpe"]
    stages = dict(P.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    assert clean.join(labels.where("toxic = 0"), "doc_id").count() >= 0.9 * labels.where("toxic = 0").join(docs, "doc_id").count()
    unique = stages["simhash_near_dedup"](spark, clean, sf_dir)
    groups = near_copies_by_all_pairs([r["text"] for r in clean.collect()])
    assert unique.columns == docs.columns and unique.count() == groups
    masked = stages["secret_scan"](spark, unique, sf_dir)
    assert masked.columns == docs.columns and masked.count() == groups and masked.where("text rlike 'AKIA[A-Z0-9]{12}'").count() == 0
    assert masked.where(F.char_length("text") != F.col("n_chars")).count() == 0
    chosen = stages["mixing"](spark, masked, sf_dir)
    assert chosen.columns == docs.columns and 0 < chosen.count() < groups
    tokens = stages["bpe"](spark, chosen, sf_dir)
    assert tokens.count() == chosen.count() and tokens.where("size(ids) <> n_tokens").count() == 0


def test_run(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    d = tables(spark, tmp_path, documents=odd.withColumn("predicted", F.lit(7)).withColumn("row", F.lit("r")), labels=labels)
    assert P.run(spark, d).count() > 0
    assert P.run(spark, tables(spark, tmp_path / "none", documents=none, labels=labels)).count() == 0


def test_repeated_rows_count_once(spark, odd, sf_dir):
    got = dict(P.STAGES)["simhash_near_dedup"](spark, odd, sf_dir)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 6 in ids and 7 not in ids


def test_whole_run_equals_plain_steps(spark):
    """run() against its stages' contracts, from the kept ids to the ids of tokens: one document of each group by all pairs, secrets
    masked, the drawn ones encoded as the tokenizers library does."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(P.STAGES)
    clean = {r["doc_id"]: r["text"] for r in stages["toxicity"](spark, docs, sf_dir).collect()}
    heads, groups = {}, near_copies_by_all_pairs(clean.values())
    for i in sorted(clean):  # a document stays if it joins no group of a lesser one
        if near_copies_by_all_pairs([*heads.values(), clean[i]]) > len(heads):
            heads[i] = clean[i]
    assert len(heads) == groups
    left = docs.where(F.col("doc_id").isin(list(heads)))
    drawn = {r["doc_id"]: r["text"] for r in stages["mixing"](spark, stages["secret_scan"](spark, left, sf_dir), sf_dir).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in drawn.items()}
    got = {r["doc_id"]: list(r["ids"]) for r in P.run(spark, sf_dir).collect()}
    assert 0 < len(got) < len(heads) and got == want


def test_columns_of_every_name(spark, odd, sf_dir):
    named = odd.withColumns({c: F.lit(c) for c in ("__judged", "judged", "__drawn", "__text", "row", "key", "print", "words", "simhash", "score", "predicted", "n", "at", "___x")})
    stages = dict(P.STAGES)
    docs = named
    for name, _ in P.STAGES[:-1]:
        docs = stages[name](spark, docs, sf_dir)
        assert docs.columns == named.columns, name
        for r in docs.collect():
            assert r["__judged"] == "__judged" and r["__drawn"] == "__drawn" and r["__text"] == "__text" and r["predicted"] == "predicted" and r["row"] == "row", name
