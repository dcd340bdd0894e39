"""Every query of the catalogue against its SQL."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from marlspike.plans import catalog
from oracle import same

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_the_optional_folder(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_captions_of_odd_texts_are_their_sql(spark, tmp_path):
    face = "\U0001f600"
    texts = ["", " \t\n ", "\x00\x1f\x85", None, face * 600, face * 1000, face * 1001, "a" * 999 + face, "\u00a0a\u3000", "\ufeff\u2028", "a\x85", "a\n\x85", "a\u2028", "a\r\n", "a" * 1000 + " ", "a" * 1000 + "\u00a0", " \x07 a", "a \r b\x0b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(catalog.QUERIES["caption_postprocess"](spark, str(tmp_path)), catalog.ORACLES["caption_postprocess"], str(tmp_path))
