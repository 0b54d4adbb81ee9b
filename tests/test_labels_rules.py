import pytest

from textprep.functions import labels, lexicons, phrases
from textprep.plans.jobs import derive_and_filter, parse_lines
from textprep.schema import detect_text_and_label, label_codes, require_columns


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("there is hope;Hope_speech;", ("there is hope", "Hope_speech", 1)),
        ("a;;b;Hope_speech;", ("a;b", "Hope_speech", 1)),
        ("hello, world;Hope_speech;", ("hello, world", "Hope_speech", 1)),
        ("only text", ("only text", None, None)),
        (";;", ("", None, None)),
        ("", ("", None, None)),
        (None, ("", None, None)),
        ("x;Other;", ("x", "Other", None)),
        (" x ; Hope_speech;", (" x ", " Hope_speech", None)),
        ("x;not-English;", ("x", "not-English", 2)),
        ("x;Non_hope_speech", ("x", "Non_hope_speech", 0)),
    ],
)
def test_parse(spark, raw, expected):
    df = parse_lines(spark.createDataFrame([(raw,)], "raw string"), label_codes("english"))
    assert rows(df, "text", "label_str", "label") == [expected]


def test_encode_label_by_substring(apply):
    values = ["Non_hope_speech", " HOPE_speech ", "not-malayalam", None, ""]
    assert apply(labels.encode_label, values) == [1, 1, 0, 0, 0]


def test_derive_label_order_and_filter(spark):
    texts = ["x notmalayalam Hope_speech", "xNon_hope_speech", "xHope_speech", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(labels.derive_label("text")).collect()] == [
        "not-Malayalam",
        "Non_hope_speech",
        "Hope_speech",
        None,
        None,
    ]
    kept = rows(derive_and_filter(df), "text", "label")
    assert kept == [("xNon_hope_speech", 0), ("xHope_speech", 1)]


def test_relabel(spark):
    data = [
        ("நம்பிக்கை இல்லை", "Hope_speech", 1),
        ("நம்பிக்கை இல்லை", "not-Tamil", 2),
        ("நம்பிக்கை", "Hope_speech", 1),
        ("இல்லை", "Hope_speech", 1),
        (None, "Hope_speech", 1),
        ("நம்பிக்கை இல்லை", None, None),
    ]
    df = spark.createDataFrame(data, "text string, label_str string, label int")
    mask = labels.relabel_mask(lexicons.TAMIL_HOPE_WORD, lexicons.TAMIL_NEGATIONS)
    assert rows(labels.count_where(df, mask), "affected") == [(1,)]
    got = rows(labels.relabel(df, mask), "label_str", "label")
    assert got == [("Non_hope_speech", 0)] + [d[1:] for d in data[1:]]


ENGLISH = (lexicons.ENGLISH_POSITIVE, lexicons.ENGLISH_NEGATIVE)
MALAYALAM = (lexicons.MALAYALAM_POSITIVE, lexicons.MALAYALAM_NEGATIVE)


@pytest.mark.parametrize(
    "lexicon, text, expected",
    [
        (ENGLISH, "there is hope", ("positive", 1)),
        (ENGLISH, "No Hope left", ("negative", 0)),
        (ENGLISH, "NEVER lose hope", ("positive", 1)),
        (ENGLISH, "not hope", ("negative", 0)),
        (ENGLISH, "i don't have hope", ("positive", 1)),
        (ENGLISH, "Hopeless", ("negative", 0)),
        (ENGLISH, "plain", ("none", 7)),
        (ENGLISH, None, ("none", 7)),
        (MALAYALAM, "ആശ ഇല്ല", ("negative", 0)),
        (MALAYALAM, "ഞങ്ങൾ വിജയിക്കും", ("positive", 1)),
    ],
)
def test_rules(spark, lexicon, text, expected):
    df = spark.createDataFrame([(text, 7)], "text string, base_pred int")
    assert rows(phrases.apply_rules(df, *lexicon), "rule", "final_pred") == [expected]


def test_rule_precedence(spark):
    df = spark.createDataFrame([("i don't have hope", 1)], "text string, base_pred int")
    got = rows(phrases.apply_rules(df, *ENGLISH, first="negative"), "base_pred", "final_pred")
    assert got == [(1, 0)]


def test_no_phrases_match_nothing(apply):
    assert apply(phrases.contains_any, ["x", None], []) == [False, False]


def test_detect_columns():
    assert detect_text_and_label(["id", "text", "label"]) == ("text", "label")
    assert detect_text_and_label(["Text1", "my_text", "label", "Hope"]) == ("my_text", "Hope")
    assert detect_text_and_label(["a", "b", "c"]) == ("a", "c")


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="label"):
        require_columns(df, ["id", "label"])
