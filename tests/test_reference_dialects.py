"""call_refs and table_refs against their SQL on texts whose words, white space and case are not of ASCII."""

import duckdb
import pytest

import __spark_entry__ as entry

ODD = [
    "Reelleè of x", "Ció of y", "éfoo of z", "fooé of z", "a_1 of b", "1a of b", "foo ( x", "foo\u000b( x", "foo \t\n\f\r( x", "class X(Base, Other):\n  pass", "class of y): ",
    "x by Yé by $a by 1b", "éextends A", " by  A", "extends\u000bB extends C extends D$é", "return of if of Range of", "", "ſtart of ſ of K of", "x by ſa by K",
    "from Que", "from Queé", "éfrom abc", "fromé abc", "from abc", "from\u000babc", "JOIN\n\tabc_d INTO only abcd", "update \"Zürich", "into only ", "from only abc", ".from('abcde') .into(\"fghij\")",
    "from ab$c from a from data from DATA", "ſfrom abc Kfrom abc", "from ſab from Kab from abſK join $abc", "xfrom abc _from abc 1from abc $from abc", "from from abc", "eresfrom abc askfrom abc aKfrom abc", None,
]


@pytest.mark.parametrize("name", ["call_refs", "table_refs"])
def test_ascii_dialect(spark, tmp_path, name):
    rows = [(i, t) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.sql(entry.oracle_sql()[name]).fetchall()}
    got = {r[0]: r[1] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert {ODD[i]: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
