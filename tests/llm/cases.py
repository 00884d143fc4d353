"""Small document tables with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"w{i}" for i in range(9000))
BASE = [f"tok{i}" for i in range(60)]


def edited(*at):
    return " ".join("new" if i in at else w for i, w in enumerate(BASE))


TEXTS = [
    (1, " ".join(BASE)), (2, " ".join(BASE).upper()), (3, edited(0)), (4, edited(59)), (5, edited(10, 30)), (6, None), (7, ""), (8, " \t\n"), (9, "One two"), (10, "one  two"),
    (11, "one two three"), (12, LONG), (13, LONG + " end"), (14, "x" * 5000), (15, "Das ist ein Satz mit ß und ü."), (16, "4111 1111 1111 1111 call +49 30 1234567"),
    (16, "4111 1111 1111 1111 call +49 30 1234567"), (None, " ".join(BASE)), (17, "12345 !!!"), (18, "a.b@c.de 10.0.0.1 GB82 WEST 1234 5698 7654 32"), (19, "é̈ 日本 <|endoftext|> it's 😀")]


def table(spark, texts=TEXTS):
    rows = [(d, t, ["en", "de", None][i % 3], f"s{i % 2}", i, 0.5, "k") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, cls string")


def none(spark):
    return table(spark).limit(0)
