"""op 3 against brute force."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, hard, table  # noqa: E402

from keystrata.llm import exact  # noqa: E402


def test_groups(spark):
    data = hard(90, words=300)
    data += [[900 + i, data[40][1], None, None, None, True, 1] for i in range(200)]
    data += [[2000 + i, data[41][1][:-1] + c, None, None, None, True, 1] for i, c in enumerate("xyxz")]
    groups = defaultdict(list)
    for x in data:
        groups[x[1] or ""].append(x[0])
    got = exact.deduplicate(table(spark, data)).collect()
    least = lambda i: -1 if i is None else i
    assert Counter((r.doc_id, r.text, r.keep_id, r.group_size) for r in got) == Counter((x[0], x[1], max(groups[x[1] or ""], key=least), len(groups[x[1] or ""])) for x in data)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "start", "keep_id", "group_size", "kept"]


def test_empty(spark):
    assert exact.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
