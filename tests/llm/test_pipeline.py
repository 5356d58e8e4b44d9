import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from llm import host_rules, mixing
from llm.rows import stored
from test_repeats import expected as cut_rows
from test_near_copies import plain_kept
from test_tokens import check_packing

ROOT = Path(__file__).resolve().parents[2]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "pack_sequences"]
    before = rows_of(docs)

    out = stages["quality_rules"](spark, docs, "")
    assert out.columns == columns
    kept = {r.doc_id for r in host_rules.judge(docs).where("kept").collect()}
    assert Counter(rows_of(out)) == Counter(r for r in before if r[0] in kept)
    docs, before = spark.createDataFrame(rows_of(out), docs.schema), rows_of(out)

    out = stages["near_dedup"](spark, docs, "")
    assert Counter((r[0], r[1]) for r in rows_of(out)) == plain_kept(before) and out.columns == columns
    docs, before = spark.createDataFrame(rows_of(out), docs.schema), rows_of(out)

    out = stages["substring_dedup"](spark, docs, "")
    want = {doc: kept for doc, _, gone, kept in cut_rows(before) if gone}
    changed = [(r[0], want.get(r[0], r[1]), *r[2:4], len(want[r[0]]) if r[0] in want else r[4]) for r in before]
    assert Counter(rows_of(out)) == Counter(changed) and out.columns == columns
    docs, before = spark.createDataFrame(changed, docs.schema), changed

    out = stages["mix_sources"](spark, docs, "")
    out = stored(out, "mixed")
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect()}
    assert Counter(rows_of(out)) == Counter({r: copies[r[0]] for r in before if copies[r[0]]})
    check_packing(rows_of(out), stages["pack_sequences"](spark, out, "").collect(), 1024)


def through_all_stages(spark, docs):
    for name, build in corpus_pipeline.STAGES:
        docs = stored(build(spark, docs, ""), name)
        yield name, docs


def test_odd_rows_through_all_stages(spark, documents, odd_rows):
    # Sentences long enough for the rules, some near and some exact copies.
    prose = " ".join(f"the quick word {i} jumps over lazy sentence {i * 7} again" for i in range(60))
    more = [(100, prose, "a"), (101, prose, "b"), (102, prose + " and then more", None), (None, prose, "c")]
    docs = documents([*odd_rows, *more], clashing=False)
    seen = dict(through_all_stages(spark, docs))
    left = [r.doc_id for r in seen["near_dedup"].collect()]
    assert left.count(100) == 1 and not {101, 102} & set(left)
    for name in ("quality_rules", "near_dedup", "substring_dedup", "mix_sources"):
        assert seen[name].columns == docs.columns
    assert seen["pack_sequences"].count() > 0


def test_an_empty_table_through_all_stages(spark, documents):
    for _, out in through_all_stages(spark, documents([], clashing=False)):
        assert out.count() == 0


def test_a_stage_removes_what_the_one_before_stored(spark, documents):
    text = " ".join(f"a fair word number {i} in a long sentence" for i in range(40))
    docs = documents([(i, f"{text} end {i}", "a") for i in range(5)], clashing=False)
    out = corpus_pipeline.substring_dedup(spark, docs, "")
    work = corpus_pipeline._before[spark.sparkContext.applicationId]
    assert work.holds(out) and work.tables and out.count() == 5
    lazily = corpus_pipeline.near_dedup(spark, out, "")  # still reads what substring_dedup stored
    assert lazily.count() >= 1 and out.count() == 5
    again = corpus_pipeline._before[spark.sparkContext.applicationId]
    corpus_pipeline.mix_sources(spark, stored(lazily, "kept"), "")
    assert not Path(again.folder(spark).removeprefix("file:")).exists()


def test_run_packs_what_the_stages_leave(spark):
    placed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    filled = Counter()
    for r in placed:
        filled[r.sequence_id] += r.length
    assert placed and max(filled.values()) <= 1024


def test_the_entry_works_without_this_package():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] in ('llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [q for q in e.queries() if q.startswith('op')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
