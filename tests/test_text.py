from pyspark.sql import functions as F

from lorekeep.functions import cleaning, text
from lorekeep.functions.times import instant


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = one(spark, text.tokens(F.lit("Redis maxIdle 8, foo.bar 连接池配置 猫 é-a_b")))
    assert got == ["redis", "maxidle", "8", "foo", "bar", "-a_b", "连接", "接池", "池配", "配置", "置", "猫"]
    assert "的是" not in one(spark, text.tokens(F.lit("他的是一个好的方案")))
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_words_are_unicode(spark):
    assert one(spark, text.words(F.lit("éa_b 中文 éa_b"))) == ["éa_b", "中文"]
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0


def test_snippet_line(spark):
    body = F.lit("first\n连接池配置 here\nredis pool\n")
    assert one(spark, text.snippet_line("连接池配置", body)) == 2
    assert one(spark, text.snippet_line("redis nothing", body)) == 3
    assert one(spark, text.snippet_line("absent", body)) is None
    assert one(spark, text.snippet("absent", body, 1)) == "first\n连接池配置 here\nredis pool"


def test_remote_key(spark):
    for url in ("git@GitHost.example:acme/repo-a.git", "https://u:p@githost.example/acme/repo-a.git", "ssh://git@githost.example:22/acme/repo-a", "git://githost.example/acme/repo-a.git"):
        assert one(spark, text.remote_key(F.lit(url))) == "githost.example/acme/repo-a"
    assert one(spark, text.remote_key(F.lit("no remote"))) is None
    assert one(spark, text.directory(F.lit("h.example/a/b c"))) == "h.example_a_b_c"


def test_url_text(spark):
    assert one(spark, text.url_text(F.lit("a+b%20c%zz%E4%B8%AD"))) == "a+b c%zz中"


def test_title_and_slug(spark):
    assert one(spark, text.title(F.lit("## Two\n# One\n"))) == "One"
    assert one(spark, text.title(F.lit("## Two\n# One\n"), True)) == "Two"
    assert one(spark, text.slug(F.lit("  Fix: 中文 The  Thing--now "))) == "fix-the-thing-now"
    assert one(spark, text.note_id(F.lit("中文"), F.lit("2026-01-01"))).startswith("2026-01-01-memory-")


def test_instant_reads_every_notation(spark):
    want = "2026-01-11 06:00:00"
    for x in ("2026-01-11T06:00:00", "2026-01-11 06:00:00", "2026-01-11T06:00:00Z", "2026-01-11T14:00:00+08:00", "2026-01-11T01:00:00.000-0500", "1768111200000", " 2026-01-11T06:00:00.000\n"):
        assert str(one(spark, instant(F.lit(x)))) == want, x
    for x in ("soon", "", "2026-13-99T00:00:00", None):
        assert one(spark, instant(F.lit(x).cast("string"))) is None


def test_clean(spark):
    long = "<tool_result>a</tool_result>" + "<tool_result>" + "x" * 6000 + "</tool_result>"
    # the first opener is the start, as nothing shorter than the bound may match
    assert one(spark, cleaning.clean(F.lit(long + "\n\n\n\nend "))) == "[工具执行结果已省略]\n\nend"
    assert one(spark, cleaning.clean(F.lit("data:image/png;base64,AAA= ok"))) == "[图片数据已省略] ok"


def test_core(spark):
    for x, want in (("ok!", False), ("继续。", False), ("short", False), ("fix it", True), ("y" * 60, True), ("  ", False)):
        assert one(spark, cleaning.is_core(F.lit(x))) is want, x


def test_redaction(spark):
    def run(x):
        out, counts = cleaning.redacted(F.lit(x))
        r = spark.range(1).select(out.alias("o"), *(c.alias(k) for k, c in counts.items())).first().asDict()
        return r.pop("o"), {k: v for k, v in r.items() if v}

    assert run("key AKIA" + "A1B2" * 4 + " end") == ("key <REDACTED:aws_access_key> end", {"aws_access_key": 1})
    out, counts = run("jdbc:mysql://h/db?password=topsecret1&x=1")
    assert "password=<REDACTED:" in out and counts == {"jdbc_password": 1, "generic_secret_kv": 1}
    assert run('secret_key = "' + "a" * 40 + '"')[1]["aws_secret_key"] == 1
    assert run("before\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\nafter") == ("before\n<REDACTED:private_key_block>\nafter", {"private_key_block": 1})
    for plain in ("def f(x): return x", "commit " + "ab" * 20, "user_id = '5f0e1c2d-1111-2222-3333-444455556666'", ""):
        assert run(plain) == (plain, {})
    assert run(None) == ("", {})
