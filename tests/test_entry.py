"""The driver's entry points, and queries of every kind against their twins."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
from lodestrata import plans

from .twins import compared

CHOSEN = [
    "semantic_topk", "knn_join_all_queries", "bm25_topk_indexed", "bm25_filtered_indexed", "hybrid_topk_indexed", "batch_search_indexed", "store_after_edits", "feed_digest", "provider_requests", "reverse_imports_mentions", "hybrid_weights_normalized", "filter_glob", "location_lookup", "rerank_hub", "file_list",
    "dry_run_totals", "ir_per_query", "memory_tags_and", "pending_changes", "cache_dedup", "chunk_line_windows", "structural_partition", "events_session",
    "readiness_matrix", "similar_exclude_same_file", "scan_eligibility", "ignore_rules", "directory_tree", "export_pages", "export_file_issues", "export_profiles",
]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.ORACLE) == set(plans.QUERIES) - {"chunk_clamp_bytes", "chunk_semantic_go", "chunk_semantic_python", "semantic_cells"}


@pytest.mark.parametrize("name", CHOSEN)
def test_twins_agree(spark, sf_dir, name):
    own, twin = compared(spark, sf_dir, plans.QUERIES[name], plans.ORACLE[name])
    assert own == twin and own


def test_line_windows_of_odd_texts(spark, sf_dir, tmp_path):
    lines = "\n".join(f"line {i}" for i in range(60))
    texts = [None, "", "\n", "\n" * 70, " \n\t\n", lines + "\n" * 9, lines.replace("\n", "\r\n"), "def f(a):\n    return a\n" + lines, *(lines.replace("20", x) for x in "\t\r\v\f\x85\xa0\u3000\u2028\0")]
    pick = random.Random(4)
    texts += ["".join(pick.choices(["\n", "a", "é", " ", *"\t\r\v\f\x1c\x85\xa0\u1680\u2003\u200b\u2028\u202f\u205f\u3000\ufeff\0\U0001f600"], [30, 4, *[1] * 19], k=pick.randrange(200))) for _ in range(300)]
    n = range(len(texts))
    columns = {"doc_id": [*n], "text": texts, "lang": [[None, "python", "go", "en"][i % 4] for i in n], "source": [f"src{i % 3}" if i % 50 != 9 else None for i in n], "n_chars": [len(x or "") for x in texts]}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    for t in os.listdir(sf_dir):
        if t != "documents.parquet":
            os.symlink(f"{sf_dir}/{t}", tmp_path / t)
    own, twin = compared(spark, str(tmp_path), plans.QUERIES["chunk_line_windows"], plans.ORACLE["chunk_line_windows"])
    assert own == twin and len(own) > len(texts)
