import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.functions.text import IRREGULAR, canon, entity_name, header, multiplicity, nfkc, relation_class, temperature_tag


def plain_canon(name):
    name = re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", unicodedata.normalize("NFKC", name).strip())
    parts = [p.lower() for p in re.split(r"[\s_\-./]+", name) if p]
    if not parts:
        return ""
    last = parts[-1]
    if last in IRREGULAR:
        last = IRREGULAR[last]
    elif last.endswith("ies") and len(last) > 4:
        last = last[:-3] + "y"
    elif last.endswith("ses") and len(last) > 4:
        last = last[:-2]
    elif last.endswith("s") and not last.endswith("ss") and len(last) > 3:
        last = last[:-1]
    return re.sub("[^a-z0-9]", "", "".join(parts[:-1]) + last)


CASES = ["Orders", "order_items", "OrderItems", "", "--", "Ⅳs", "ﬁles", "éa", "cafés", "K", "Status", "statuses", "ＯｒｄｅｒＩｔｅｍｓ", "data", "⑩x", "class", "cities", "A B", "public.Person", "és", "𝐀bs"]


def test_canon_cases(spark):
    df = spark.createDataFrame([(c,) for c in CASES] + [(None,)], "n string")
    for name, found in df.select("n", canon(F.col("n"))).collect():
        assert found == (None if name is None else plain_canon(name)), name


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBcS_-. 1é́ｆⅨﬀ ½sesies"), max_size=12), min_size=1, max_size=40))
def test_canon_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[1] for r in df.select("n", canon(F.col("n"))).collect()] == [plain_canon(n) for n in names]


def test_small_functions(spark):
    df = spark.createDataFrame([("0..N",), (" 1 .. * ",), ("one",), ("2..n",), ("M",)], "c string")
    assert [r[0] for r in df.select(multiplicity(F.col("c"))).collect()] == ["many", "many", "one", "one", "many"]
    one = spark.range(1)
    assert one.select(relation_class(F.lit("one"), F.lit("many"))).first()[0] == "1:N"
    assert one.select(relation_class(F.lit("many"), F.lit("one"))).first()[0] == "N:1"
    assert [one.select(entity_name(F.lit(c))).first()[0] for c in ("client_id", "n_order", "id", "airport_departure")] == ["Client", "Order", "Id", "AirportDeparture"]
    assert one.select(header(F.lit("passport"), F.lit(1), "none")).first()[0] == "c1"
    assert one.select(temperature_tag(F.lit(0.2))).first()[0] == "02"
    assert one.select(nfkc(F.lit(None).cast("string"))).first()[0] is None
