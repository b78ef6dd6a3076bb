from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import text
from parley.plans.settings import Settings
from parley.sources import media

#: Code points whose lower case or case folding differs between Unicode versions and engines.
ODD = set("ßẞİıſᲉꟋꟌꟚꟜΣσς")


def column(spark, values, expr):
    rows = [(k, v) for k, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, "k int, x string").repartition(1).sortWithinPartitions("k").select(expr).collect()]


def test_times(spark):
    ms = [0, 999, 59999, 3599999, 3600000, 3661001]
    out = [r[0] for r in spark.createDataFrame([(m,) for m in ms], "m long").coalesce(1).select(text.minutes_seconds(F.col("m"))).collect()]
    assert out == ["00:00", "00:00", "00:59", "59:59", "00:00", "01:01"]


def test_names(spark):
    names = ["a.mp3", "a.b.mp3", ".mp3", "noext", "archive.", "..x"]
    assert column(spark, names, text.stem(F.col("x"))) == [n.split(".")[0] for n in names]
    assert column(spark, names, text.extension(F.col("x"))) == [".mp3", ".mp3", "", "", ".", ""]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF), max_size=12), min_size=30, max_size=60))
def test_strip_and_contains_like_python(spark, values):
    values = [v.replace("\x00", "") for v in values]
    assert column(spark, values, text.strip(F.col("x"))) == [v.strip() for v in values]
    for q in ("%", ".", "$5", "\\E", " ", "é"):
        got = column(spark, values, text.contains_ci(F.col("x"), q))
        assert [g for g, v in zip(got, values) if not ODD & set(v)] == [q.lower() in v.lower() for v in values if not ODD & set(v)]


def test_highlight(spark):
    values = ["a.b A.B axb", "cost $5", "x\\Ey", "École école", None, ""]
    assert column(spark, values, text.highlight(F.col("x"), "a.b"))[0] == "<b>a.b</b> <b>A.B</b> axb"
    assert column(spark, values, text.highlight(F.col("x"), "$5"))[1] == "cost <b>$5</b>"
    assert column(spark, values, text.highlight(F.col("x"), "\\E"))[2] == "x<b>\\E</b>y"
    assert column(spark, values, text.highlight(F.col("x"), "É"))[3] == "<b>É</b>cole <b>é</b>cole"
    assert column(spark, values, text.highlight(F.col("x"), "")) == values
    assert column(spark, ["<i>&b"], text.highlight_escaped(F.col("x"), "&")) == ["&lt;i&gt;<b>&amp;</b>b"]


def test_blank_items_go(spark):
    rows = spark.sql("select array('a', ' ', '', null, ' b ') as items")
    assert rows.select(text.not_blank(F.col("items"))).first()[0] == ["a", " b "]


def test_template_is_filled_once(spark):
    assert column(spark, ["{b}"], text.fill("{a}-{b}-{c}", a=F.col("x"), b=F.lit("1"))) == ["{b}-1-{c}"]


def test_media(spark, tmp_path):
    for n in ("a.mp3", "b.txt", "c.flac"):
        (tmp_path / n).write_bytes(b"x")
    assert media.scan(spark, str(tmp_path)).count() == 2
    rows = spark.createDataFrame([("b.txt",), ("c.FLAC",)], "name string").withColumn("mime", media.mime_type(F.col("name")))
    assert [(r.source_path, r.code) for r in media.rejects(rows, "name", "mime").collect()] == [("b.txt", 415)]


def test_accepted_types(spark):
    wanted = "audio/mpeg audio/wav audio/x-wav audio/mp4 audio/ogg audio/webm audio/flac video/mp4 video/webm video/quicktime video/x-matroska".split()
    rows = spark.createDataFrame([(m,) for m in [*wanted, "text/plain", None]], "m string").select(media.accepted(F.col("m")))
    assert [r[0] for r in rows.collect()] == [True] * len(wanted) + [False, False]


def test_settings():
    assert Settings.load({}).max_retries == 2
    assert Settings.load({"MAX_RETRIES": "5", "TEMPERATURE": "0.5", "model_name": "x"}) == Settings(max_retries=5, temperature=0.5)
