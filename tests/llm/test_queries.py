import duckdb

from candlemill.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == [*range(1, 14)]


def test_url_filter_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    want = con.execute(queries.OP6_SQL).fetchall()
    found = queries.QUERIES["op6_url_filter"](spark, FOLDER)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())


def test_digests(spark):
    for name, columns in {
        "op2_html_template": ["page_id", "url", "text", "n_chars"], "op4_source_mix": ["doc_id", "source", "size", "source_size", "target", "taken", "rate", "copies"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"], "op10_langid": ["doc_id", "held_out", "lang_pred", "score", "n_spans"],
        "op11_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        "op12_token_align": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"], "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op8_chat_format": ["conv_id", "seq", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"],
    }.items():
        assert queries.QUERIES[name](spark, FOLDER).columns == columns


def test_types_of_digests(spark):
    kinds = {"op11_whitening": "bigint,int,bigint,bigint,double,double,double", "op12_token_align": "bigint," * 7 + "string", "op13_token_files": "bigint,bigint,bigint,bigint"}
    for name, types in kinds.items():
        assert ",".join(t for _, t in queries.QUERIES[name](spark, FOLDER).dtypes) == types
