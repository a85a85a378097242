import hashlib
from collections import defaultdict

import pytest

from lexispark.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, run int, digest string, best long"


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_against_brute_force(spark, keep, parts):
    rows = [(i, ["Text %d" % (i % 37), "TEXT %d É" % (i % 11), "", None, "x" * 50000][i % 5]) for i in range(400)] + [(3, "Text 3"), (3, "Text 3"), (None, "text 3"), (None, "alone")]
    got = exact_dedup(spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], SCHEMA).repartition(parts), keep=keep).collect()
    digest = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.text_sha256]
        ids = [i for i in own if i is not None]
        want = (max if keep == "max" else min)(ids) if ids else None
        assert (r.keep_id, r.group_size, r.kept) == (want, len(own), r.doc_id is not None and r.doc_id == want)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
