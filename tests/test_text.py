from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions import text as T


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_query_terms():
    got = T.query_terms("系统标题在哪里修改 generateWithRetry the login")
    assert got[0] == ("系统标题", "cjk:系统标题")
    assert ("标题", "cjk_sub:标题") in got and ("title", "expand:系统标题") in got
    assert {"generate", "Retry", "generateWithRetry", "login"} <= {t for t, _ in got} and "the" not in {t for t, _ in got}
    assert T.query_terms("") == []


def test_tokens(spark):
    assert one(spark, T.camel_parts(F.lit("generateWithRetry"))) == ["generate", "With", "Retry", "generateWithRetry"]
    assert one(spark, T.camel_parts(F.lit("login"))) == ["login"]
    assert one(spark, T.topic_tokens(F.lit("X affects loginUser and deadbeef12 abc_d"))) == ["abc_d", "loginUser"]
    assert one(spark, T.is_specific(F.lit("navbar"))) is False and one(spark, T.is_specific(F.lit("nav_bar"))) is True
    assert one(spark, T.segments(F.lit("系统标题在哪里"))) == ["系统标题"]
    assert one(spark, T.quoted_cjk(F.lit("""a("登录") + '系统' + "x" """))) == ["登录", "系统"]


def test_scalars(spark):
    import zlib

    assert one(spark, T.stable_id(F.lit("a"), F.lit("b"))) == f"{zlib.crc32(b'a' + bytes([0x1F]) + b'b'):08x}"
    assert one(spark, T.stem(F.lit("src/app/page.tsx"))) == "page" and one(spark, T.suffix(F.lit("a/.env"))) == ""
    assert one(spark, T.extension_weight(F.lit("a.json"))) == 0.8 and one(spark, T.extension_weight(F.lit("Makefile"))) == fixed.OTHER_EXTENSION_WEIGHT
    assert one(spark, T.camel_name(F.lit("/api/auth-login"))) == "ApiAuthLogin"
    assert one(spark, T.split_clauses(F.lit("登录坏了，保留标题"))) == ("登录坏了，", "标题")
    assert one(spark, T.split_clauses(F.lit("all broken"))) == ("all broken", "")
    assert one(spark, T.symbol_pick(F.lit("who calls generateWithRetry now"))) == "generateWithRetry"
    assert one(spark, T.domain_hits(F.lit("Login page title"), F.array(F.lit("login")))) == {"auth": 2, "title": 1}
    assert one(spark, T.json_text(F.lit('say ```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert len(one(spark, T.bounded(F.lit("x" * 5000)))) == 2005
