from tidemark.sources.rejects import read_csv_checked, sampled_schema


def test_every_row_is_good_or_rejected_with_a_reason(spark, tmp_path):
    lines = ["id,name,day", '1,"a,b",2024-01-02', "x,c,2024-01-03", "3,d", "4,e,2024-01-04,more", "5,,", "6,f,not-a-day", '7,"say ""hi""",2024-02-01']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("id,name,day\n8,g,2024-03-01\n")
    read = read_csv_checked(spark, str(tmp_path), "id long, name string, day date")
    assert sorted((r["id"], r["name"]) for r in read.good.collect()) == [(1, "a,b"), (5, None), (7, 'say "hi"'), (8, "g")]
    reasons = {r["text"]: r["reason"] for r in read.rejected.collect()}
    assert reasons == {"x,c,2024-01-03": "id is no bigint", "3,d": "too few values", "4,e,2024-01-04,more": "too many values", "6,f,not-a-day": "day is no date"}
    assert all(r["file"].endswith("a.csv") for r in read.rejected.collect())
    # Counts of one column alone look at whole rows, too.
    assert read.good.select("name").count() == 4 and read.good.count() == 4 and read.rejected.count() == 4


def test_a_schema_from_a_bounded_sample(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},{i}\n" for i in range(50)) + "50,late\n")
    assert sampled_schema(spark, f"{tmp_path}/a.csv", lines=20).simpleString() == "struct<id:int,v:int>"
    read = read_csv_checked(spark, f"{tmp_path}/a.csv", sampled_schema(spark, f"{tmp_path}/a.csv", lines=20))
    assert read.good.count() == 50 and [r["reason"] for r in read.rejected.collect()] == ["v is no int"]
    assert read_csv_checked(spark, f"{tmp_path}/a.csv").good.count() == 51  # the whole file is in the sample: v is text
