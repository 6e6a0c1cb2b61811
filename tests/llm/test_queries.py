"""The columns of queries against plain versions of their contracts."""

import hashlib

import pytest

from driftmesh.llm import pii, queries

from .test_texts import plain_pii, plain_secrets


@pytest.fixture
def rows_of(docs_of, spark, tmp_path):
    """doc_id -> row of a query over a table of these texts."""

    def run(query, texts):
        docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
        return {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}

    return run


def digest(names, spans):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op7_counts_each_kind(rows_of):
    key, long_hex = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    texts = [None, "", "token=abcdef", "token=abcdef secret: hunter22 passwd=short", f"{key} {key} token=abcdef", f"{long_hex} {long_hex} {key}", f"😀 token={long_hex} AKIAAKIA"]
    for i, r in rows_of(queries.op7_secret_scan, texts).items():
        base = plain_secrets(texts[i] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)], texts[i]
        assert r.base_sha256 == digest(("assign", "access", "hex"), [(k, a, b) for a, k, b in base])


def test_op9_counts_each_kind_and_parts_of_many_zeros(rows_of):
    card = "4111 1111 1111 1111"
    zeros = "0" * 5000
    texts = [None, "", "a@b.cc d@e.ff", f"a@b.cc 1.2.3.4 10.0.0.255 {card} +1 555 123 4567", f"{card} {card} 256.1.1.1", f"{zeros}1.2.3.4 {zeros}.0.0.0", f"😀 +49 (30) 1234567 {'9' * 5000}.1.1.1"]
    for i, r in rows_of(queries.op9_pii, texts).items():
        # Python reads no number of 5,000 digits, but their lengths are known here
        base = plain_pii((texts[i] or "").replace(zeros, "0").replace("9" * 5000, "999"))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in range(4)], texts[i]
        if i < 5:
            assert r.base_sha256 == digest(pii.KINDS, base)
    assert pii.base_spans(f"{zeros}1.2.3.4 {zeros}.0.0.0") == [(1, 0, 5007), (1, 5008, 10014)]
