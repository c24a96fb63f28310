from stratakeep.plans.options import from_dotted, merge, server_settings


def test_merge():
    assert merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}


def test_dotted():
    assert from_dotted([("a.b", 1), ("a.c", 2), ("a.b", 3), ("x", 4)]) == {"a": {"b": 3, "c": 2}, "x": 4}
    assert from_dotted([("a.b", 1), ("a", 5)]) == {"a": {"b": 1}}


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<config><disk><name>s3</name><type>s3</type></disk><disk><name>local</name><type>local</type></disk></config>")
    assert {r["name"] for r in server_settings(spark, str(tmp_path / "c.xml"), "disk").collect()} == {"s3", "local"}
