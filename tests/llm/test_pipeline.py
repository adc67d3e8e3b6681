import re
from collections import defaultdict

import corpus_pipeline as C
import numpy as np
import pytest
from tokenizers import Tokenizer

from foliospark.llm import op08_toxicity, tokens
from foliospark.session import table
from tests.llm.test_op03 import brute as groups
from tests.llm.test_op06 import brute as leaks
from tests.llm.test_op10 import brute as secrets

D = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, docs, D)
        if name == "packing":
            break
        assert out.columns == columns and out.dtypes == docs.dtypes
        got = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(got)
        texts = [(k, r["text"]) for k, r in rows.items()]
        if name == "toxicity":
            m = op08_toxicity.machine_for(docs, spark, D)
            want = {r["doc_id"] for r in op08_toxicity.score_toxicity(docs, m).where("score < 0.7").collect()}
            assert len(rows) - len(got) < 0.25 * len(rows)
        elif name == "near_duplicates":
            want = {i for i, first, _, _ in groups(texts) if i == first}
            assert len(got) < len(rows)
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, D, "benchmark").select("item_id", "text").collect()]
            want = {k for k, _ in texts} - {texts[i][0] for i, _ in leaks(texts, items)}
            assert len(got) < len(rows)
        else:
            want = set(rows)
            for k, r in got.items():
                assert not secrets(r["text"]) and r["n_chars"] == len(r["text"])
                assert ("[SECRET]" in r["text"]) == bool(secrets(rows[k]["text"]))
        assert set(got) == want
        if name != "secrets":
            assert all(tuple(got[k]) == tuple(rows[k]) for k in got)
        rows, docs = got, spark.createDataFrame(list(got.values()), docs.schema)
    direct = Tokenizer.from_file(tokens.vocabulary_path())
    pieces = defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(rows)
    for k, found in pieces.items():
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(found, key=lambda p: p["start"])])
        assert ids.tolist() == [*direct.encode(rows[k]["text"] or "", add_special_tokens=False).ids, 2]


def test_run_equals_its_stages(spark):
    got = C.run(spark, D)
    assert got.columns[0] == "doc_id" and got.count() > 0
    assert re.fullmatch("toxicity,near_duplicates,decontamination,secrets,packing", ",".join(n for n, _ in C.STAGES))


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stages_take_empty_and_odd_tables(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", None, 0, "x"), (None, "a b c d e f g", "en", "s", 13, "x"), (3, "a b c d e f g", "en", "s", 13, "x"), (3, "a b c d e f g", "en", "s", 13, "x"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, D)
    assert stage(spark, df.limit(0), D).count() == 0
    if name != "packing":
        got = sorted(map(repr, map(tuple, out.collect())))
        want = [r for i, r in enumerate(rows) if name != "near_duplicates" or i not in (2, 4)]  # one row of the class of id 3
        assert got == sorted(map(repr, want)) or (name == "toxicity" and set(got) <= set(map(repr, want)))
