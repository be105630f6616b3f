"""The jobs over growing input, broken-off runs and reruns, and inference by subject against each subject alone."""

import json
import logging
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import infer
from cytoloom.sources import domain
from jobs import common, queries, subject_networks, text_profiles

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
SMALL = {"permutations": 5, "min_cells": 5}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("*.parquet")}


def copied(spark, folder, keep):
    """The star schema with the customers that `keep` names."""
    for name in ("nation", "region", "orders", "lineitem", "part"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{DATA}/customer.parquet").filter(keep).write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_networks_take_new_subjects_only(spark, tmp_path):
    first = copied(spark, tmp_path / "first", "c_nationkey < 8")
    grown = copied(spark, tmp_path / "grown", "true")
    out = str(tmp_path / "out")
    n = subject_networks.run(spark, {"tables": first, "output": out, **SMALL})
    held, before = rows(subject_networks.networks(spark, out)), files(f"{out}/networks")
    assert 0 < n == len({r[0] for r in held})
    more = subject_networks.run(spark, {"tables": grown, "output": out, **SMALL})
    after, now = rows(subject_networks.networks(spark, out)), files(f"{out}/networks")
    assert more > 0 and before.items() <= now.items() and set(held) < set(after)
    assert subject_networks.run(spark, {"tables": grown, "output": out, **SMALL}) == 0 and files(f"{out}/networks") == now
    once = str(tmp_path / "once")
    assert subject_networks.run(spark, {"tables": grown, "output": once, **SMALL}) == n + more
    assert rows(subject_networks.networks(spark, once)) == after


def test_networks_after_a_run_that_broke_off_and_under_other_settings(spark, tmp_path, monkeypatch):
    tables = copied(spark, tmp_path / "in", "c_nationkey < 8")
    out, config = str(tmp_path / "out"), {"tables": tables, "output": str(tmp_path / "out"), **SMALL}
    write = subject_networks.replace_partitions

    def broken(df, path, partition):
        if path.endswith("finished"):
            raise OSError("lost before the mark")
        write(df, path, partition)

    monkeypatch.setattr(subject_networks, "replace_partitions", broken)
    with pytest.raises(OSError, match="lost"):
        subject_networks.run(spark, config)
    held = rows(subject_networks.networks(spark, out))
    monkeypatch.setattr(subject_networks, "replace_partitions", write)
    n = subject_networks.run(spark, config)
    assert n > 0 and rows(subject_networks.networks(spark, out)) == held
    assert subject_networks.run(spark, {**config, "permutations": 6}) == n
    assert len(rows(subject_networks.networks(spark, out))) == len(held)


def test_refresh_takes_subjects_that_grew(spark, tmp_path):
    small = copied(spark, tmp_path / "small", "c_nationkey < 6 AND NOT (c_nationkey = 2 AND c_custkey % 9 = 0)")
    grown = copied(spark, tmp_path / "grown", "c_nationkey < 6")
    out = {"output": str(tmp_path / "out"), **SMALL, "min_cells": 2}
    n = subject_networks.run(spark, {"tables": small, **out})
    assert n > 1 and subject_networks.run(spark, {"tables": grown, **out}) == 0
    assert subject_networks.run(spark, {"tables": grown, **out, "refresh": True}) == 1
    assert subject_networks.run(spark, {"tables": grown, **out, "refresh": True}) == 0


def test_a_subject_stands_alone(spark):
    """run_by_subject gives each subject what run_inference gives it alone, with the whole panel there."""
    nodes = ["a", "b", "c"]
    cells = [(s, f"{s}{i}", nodes[i % 3]) for s in ("s1", "s2", "s3") for i in range(12)] + [(None, "lost", "a"), ("s1", "bare", None)]
    values = [(c, g, float((i * 7 + j * 5) % 11 + (s == "s2") * 3)) for i, (s, c, _) in enumerate(cells) for j, g in enumerate("xyzw") if (i + j) % 3 and not (s == "s3" and g == "x")]
    cells = spark.createDataFrame(cells, "subject string, cell_id string, node string")
    expr = spark.createDataFrame([v for v in values if v[2]], "cell_id string, gene string, value double")
    rules = domain.rule_table(spark, [("R", ["x", "y"], [1, 2], [1.0, 1.0], ["z"], [1], [1.0]), ("S", ["y"], [1], [1.0], ["w"], [1], [1.0]), ("T", ["q"], [1], [1.0], ["w"], [1], [1.0])])
    panel = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "gene string")
    got = rows(infer.run_by_subject(expr, cells, rules, panel, m=20).select("subject", "lr_name", "sender", "receiver", F.round("prob", 9), "pvalue", F.round("net", 9)))
    assert {r[1] for r in got} == {"R", "S"} and len(got) == 3 * 2 * 9
    assert all(r[4] == 0 and r[5] is None for r in got if r[:2] == ("s3", "R"))  # a gene that the subject lacks is zero
    for s in ("s1", "s2"):
        own = cells.filter(F.col("subject") == s).filter("node IS NOT NULL").select("cell_id", "node")
        alone = infer.run_inference(expr.join(own.select("cell_id"), "cell_id", "left_semi"), own, rules, m=20)
        want = rows(alone.select(F.lit(s), "lr_name", "sender", "receiver", F.round("prob", 9), "pvalue", F.round("net", 9)))
        assert [r for r in got if r[0] == s] == want
    for how in ("hill", "minmean"):
        assert infer.run_by_subject(expr, cells, rules, panel, m=3, method=how).count() == len(got)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, gene string, cells int, batch string"
FIRST = [(1, "the cat the dog", "en", "s0"), (2, None, "en", "s0"), (3, "", None, None), (4, "A B\na\tb", "de", "s0"), (4, "A B\na\tb", "de", "s0")]
MORE = [(5, "the the THE mouse", "en", "s0"), (6, " ".join(f"w{i}" for i in range(20_000)), "fr", "s1"), (7, "le the", "fr", "s/ 1%")]


def put(spark, folder, given, mode="append"):
    spark.createDataFrame([(*r, 1, "g", 2, "b") for r in given], DOCS).coalesce(1).write.mode(mode).parquet(folder)


def rounded(spark, out):
    return rows(text_profiles.result(spark, out).withColumns({c: F.round(c, 9) for c in ("mean", "entropy")}))


def test_profiles_read_new_files_only(spark, tmp_path, caplog):
    docs, out, mark = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "mark")
    config = {"documents": docs, "output": out, "checkpoint": mark}
    put(spark, docs, FIRST)
    put(spark, f"{docs}2", MORE)  # a neighbour whose name begins the same
    with caplog.at_level(logging.INFO, "jobs"):
        assert text_profiles.run(spark, config) == len(FIRST)
        held, sums = rounded(spark, out), files(f"{out}/sums")
        put(spark, docs, MORE)
        assert text_profiles.run(spark, config) == len(MORE)
    assert sums.items() <= files(f"{out}/sums").items()
    after = rounded(spark, out)
    assert after != held and text_profiles.run(spark, config) == 0 and rounded(spark, out) == after
    said = [json.loads(r.message) for r in caplog.records if r.name == "jobs"]
    assert [s["rows"] for s in said if s["event"] == "read"] == [len(FIRST), len(MORE)]
    once = {"documents": docs, "output": str(tmp_path / "once"), "checkpoint": str(tmp_path / "once-mark"), "files_per_batch": 1}
    assert text_profiles.run(spark, once) == len(FIRST + MORE)
    assert rounded(spark, once["output"]) == after
    by = {(r[0], r[1], r[2]): r[3:] for r in after}
    assert by["s0", "en", "the"][:2] == (3, 2) and by["s0", "de", "a"][:2] == (2, 2) and by["s1", "fr", "w7"][1] == 1
    assert by["s0", "en", "cat"][3] == 0 and ("s/ 1%", "fr", "le") in by and not any(r[0] == "unknown" for r in after)
    with pytest.raises(Exception, match="another checkpoint"):
        put(spark, docs, MORE)
        text_profiles.run(spark, {**once, "checkpoint": str(tmp_path / "lost")})


def test_profiles_after_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    docs = str(tmp_path / "documents.parquet")
    config = {"documents": docs, "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    put(spark, docs, FIRST + MORE)
    whole = text_profiles.told

    def broken(job, event, **what):
        if event == "batch":
            raise OSError("lost after the sums")
        whole(job, event, **what)

    monkeypatch.setattr(text_profiles, "told", broken)
    with pytest.raises(Exception, match="lost after"):
        text_profiles.run(spark, config)
    monkeypatch.setattr(text_profiles, "told", whole)
    assert text_profiles.run(spark, config) == len(FIRST + MORE)
    again = {**config, "output": str(tmp_path / "again"), "checkpoint": str(tmp_path / "again-mark")}
    text_profiles.run(spark, again)
    assert rounded(spark, config["output"]) == rounded(spark, again["output"])


def test_profiles_of_an_empty_table(spark, tmp_path):
    docs = str(tmp_path / "documents.parquet")
    put(spark, docs, [])
    assert text_profiles.run(spark, {"documents": docs, "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}) == 0
    assert text_profiles.result(spark, str(tmp_path / "out")).isEmpty()


def test_a_run_without_new_files_keeps_the_profiles(spark, tmp_path, monkeypatch):
    docs, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    config = {"documents": docs, "output": out, "checkpoint": str(tmp_path / "mark")}
    put(spark, docs, FIRST)
    text_profiles.run(spark, config)
    held = files(f"{out}/profiles")
    assert text_profiles.run(spark, config) == 0 and files(f"{out}/profiles") == held
    put(spark, docs, MORE)
    add_up = text_profiles.profiles

    def broken(sums):
        raise OSError("lost before the profiles")

    monkeypatch.setattr(text_profiles, "profiles", broken)
    with pytest.raises(OSError, match="lost before"):
        text_profiles.run(spark, config)
    monkeypatch.setattr(text_profiles, "profiles", add_up)
    assert text_profiles.run(spark, config) == 0  # the stream has read all, but profiles are behind
    once = {**config, "output": str(tmp_path / "once"), "checkpoint": str(tmp_path / "once-mark")}
    assert text_profiles.run(spark, once) == len(FIRST + MORE)
    assert rounded(spark, out) == rounded(spark, once["output"])
    shutil.rmtree(f"{out}/profiles")
    assert text_profiles.run(spark, config) == 0 and rounded(spark, out) == rounded(spark, once["output"])


def test_words_are_counted_where_documents_are_read(spark, monkeypatch):
    monkeypatch.setattr(text_profiles, "BLOCK", 40)
    odd = [chr(c) for c in [*range(0x100), 0x130, 0x1680, 0x2003, 0x2028, 0x212A, 0x3000, 0xFEFF, 0x1F600]]
    texts = [f"Word{c}woRD {c}" for c in odd] + [None, "", " \t\n", "x y X", " ".join(f"w{i % 90}" for i in range(300))]
    docs = spark.createDataFrame([(t, f"s{i % 3}", None if i % 5 else "en") for i, t in enumerate(texts)], "text string, source string, lang string")
    lower = str.maketrans(text_profiles.UPPER, text_profiles.LOWER)
    want = []
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[ \t-\r]+", (t or "").translate(lower)) if w]
        want += [(f"s{i % 3}", None if i % 5 else "en", w, float(n), len(words)) for w, n in Counter(words).items()]
    made = text_profiles.counts(docs)
    assert rows(made) == sorted(want, key=str)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_profiles_shuffle_the_sums_once(spark):
    sums = spark.createDataFrame([("s", "en", "a", 1, 2.0, 0), ("s", "en", "a", 1, 1.0, 1), ("s", "de", "a", 2, 3.0, 1), ("s", "en", None, 2, 0.0, 0), ("s", "en", None, 2, 0.0, 1), ("s", "de", None, 4, 0.0, 1)], text_profiles.SUMS)
    made = text_profiles.profiles(sums)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert rows(made) == [("de", "a", 4, 2, 0.75, 1.0, "s"), ("en", "a", 4, 2, 0.75, 1.0, "s")]
    dealt = re.findall(r"Exchange (\w+)\((\w+?)#\w+(?: ASC NULLS FIRST)?, (\w+?)#", plan)
    assert sorted(dealt) == [("hashpartitioning", "region", "cell_type"), ("rangepartitioning", "region", "gene")]  # the former are the groups' sizes


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got), check_dtype=False, atol=2e-6, rtol=1e-9)


@pytest.mark.parametrize("name", ["subject_networks", "text_profiles"])
def test_config_file_and_command_line(name):
    config = common.settings(str(Path(common.__file__).with_name(f"{name}.json")), {"output": "/elsewhere", "rules": None})
    assert config["output"] == "/elsewhere" and config != common.settings(str(Path(common.__file__).with_name(f"{name}.json")), {})


def test_a_job_from_the_command_line(tmp_path):
    call = [sys.executable, "-m", "jobs.text_profiles", "--documents", f"{DATA}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    done = subprocess.run(call, cwd=Path(common.__file__).parent.parent, capture_output=True, text=True, timeout=300, env={**os.environ, "SPARK_LOCAL_DIRS": str(tmp_path)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert '"event": "written"' in done.stderr and list(Path(tmp_path, "out/profiles").glob("region=*"))
