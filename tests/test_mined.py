from __future__ import annotations

import re

from quillmatch.functions.text import PROSE_STOPS
from quillmatch.plans.queries import text_functions
from tests.conftest import DATA


def test_tokens_of_the_whole_text_are_mined(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    got = sorted((r.conv_id, r.turn, r.role, r.mined) for r in text_functions(spark, DATA).collect())
    assert any(len(r.text) > 300 for r in rows)
    want = [(r.conv_id, r.turn, r.role, "|".join(dict.fromkeys(w for w in re.findall("[a-z]{4,}", r.text.lower()) if w not in PROSE_STOPS))) for r in rows]
    assert got == sorted(want)
