import contextlib
import io


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, expr, **values):
    """Value of a column expression over a one-row frame of the named values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in _types(values)))
    return df.select(expr.alias("x")).first()["x"]


def _types(values):
    for name, v in values.items():
        if isinstance(v, list):
            yield name, "array<double>" if v and isinstance(v[0], float) else "array<int>"
        else:
            yield name, {str: "string", int: "int", float: "double", type(None): "string"}[type(v)]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def runs_python(df):
    return any(node in plan(df) for node in ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))
