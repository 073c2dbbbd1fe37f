import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabprep.operators import headers as hd
from tabprep.operators import mapping as mp
from tabprep.sources import tables as tb
from test_cleaning import sheet

LONG = "FOTO_del_equipo___HTTP://example.com/image.PNG !!! historial de casos con comentarios y metadata redundante"
VERBOSE = "|" * 50 + " Inventario mensual consolidado con 2024-08-01 y 10.000 referencias y ciudades y direcciones y costos"


def heads(spark, *names, sheet_id="s"):
    return spark.createDataFrame([(sheet_id, i, n) for i, n in enumerate(names)], tb.HEADERS_DDL)


def test_types_of_headers(spark):
    found = {r.header: r for r in hd.classify_columns(heads(spark, "Foto del equipo", "Fecha de visita", LONG, "Calle y número", "")).collect()}
    assert found["Foto del equipo"].type == "photo" and found["Foto del equipo"].confidence > 0.8
    assert found["Fecha de visita"].type == "date" and found["Fecha de visita"].confidence > 0
    assert found[LONG].type == "photo" and found[LONG].evidence == ["foto", "image"]
    assert found["Calle y número"].type == "address" and found["Calle y número"].confidence == 0.88
    assert found[""].evidence == []


def test_scores_are_probabilities(spark):
    for r in hd.score_types(heads(spark, "direccion cliente", VERBOSE, "", "fecha " * 40)).collect():
        scores = [s.score for s in r.scores]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
        assert sum(scores) == pytest.approx(1, abs=1e-5)


def test_filter_on_the_class_keeps_the_plan_small(spark):
    classified = hd.classify_columns(heads(spark, "Fecha", "Monto")).filter("type = 'date'")
    assert len(classified._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert [r.header for r in classified.collect()] == ["Fecha"]


def test_pos_and_location(spark):
    classified = hd.classify_columns(heads(spark, "Numero POS", "Dirección", "Latitud", "Longitud"))
    pos = hd.detect_pos(classified)
    p = pos.first()
    assert (p.pos_column, p.pos_confidence, p.missing_required) == ("Numero POS", 0.93, False)
    assert p.sample_values == ["{{Numero POS}}", "{{Numero POS}}-alt"]
    assert p.normalized_samples == ["POS-NUMERO POS", "POS-NUMERO POS-SITE"]
    g = hd.validate_geo(classified, pos).first()
    assert (g.address_column, g.latitude_column, g.longitude_column, g.geo_ok, g.issues) == ("Dirección", "Latitud", "Longitud", True, [])
    assert hd.title_hint(pos).first().title_template == "POS {{Numero POS}} - Incidencia reportada"


def test_nothing_found(spark):
    classified = hd.classify_columns(heads(spark, "Cliente"))
    pos = hd.detect_pos(classified)
    p = pos.first()
    assert (p.pos_column, p.pos_confidence, p.missing_required, p.warnings) == (None, 0.32, True, ["pos-not-found"])
    g = hd.validate_geo(classified, pos).first()
    assert (g.geo_confidence, g.geo_ok, g.issues) == (0.35, False, ["address-missing", "coordinates-missing", "pos-required"])


def test_whole_tokens_on_request(spark):
    both = [hd.keyword_best(heads(spark, "Codigo postal", "Cantidad"), {"pos": ["pos", "tid"]}, whole_token=w).first() for w in (False, True)]
    assert both[0].pos_column == "Codigo postal" and both[1].pos_column is None


def test_identity_is_the_first_hit(spark):
    assert hd.identity_column(heads(spark, "Cliente", "RUT técnico", "DNI")).first().identity_column == "RUT técnico"


def test_titles(spark):
    s = sheet(spark, ["POS", "Cliente"], [["7", "Ana"], [None, "Luz"]])
    hints = spark.createDataFrame([("s", "Visita POS {{POS}} - {{Cliente}}")], "sheet_id string, title_template string")
    assert [r.title for r in hd.render_titles(s, hints).orderBy("row_idx").collect()] == ["Visita POS 7 - Ana", "Visita POS  - Luz"]


FIELDS = [
    ("cliente", "Cliente", True, ["cliente final", "razon social"]),
    ("direccion", "Dirección", True, ["direccion cliente", "ubicacion"]),
]


@pytest.mark.parametrize(
    "columns, cliente, direccion",
    [
        (["Cliente", "Direccion Cliente"], "Cliente", "Direccion Cliente"),
        (["Direccion Cliente"], None, "Direccion Cliente"),
        (["Ubicacion Cliente"], None, "Ubicacion Cliente"),
        (["Otra"], None, None),
    ],
)
def test_field_mapping(spark, columns, cliente, direccion):
    fields = mp.field_table(spark, FIELDS, ["direccion", "cliente"])
    found = {r.field_id: r.header for r in mp.map_fields(heads(spark, *columns), fields).collect()}
    assert found == {"cliente": cliente, "direccion": direccion}


def test_mapping_equals_a_plain_greedy_loop(spark):
    """Wide sheets with many rivals: the shortened candidate list must not change the outcome."""
    import random

    rng = random.Random(2)
    words = ["cliente", "direccion", "fecha", "tecnico", "ubicacion", "calle", "empresa", "visita", "x"]
    sheets = [(f"s{k}", i, " ".join(rng.sample(words, rng.randint(1, 3)))) for k in range(30) for i in range(40)]
    headers = spark.createDataFrame(sheets, tb.HEADERS_DDL)
    table = mp.field_table(spark)
    fields = table.collect()
    want = {}
    for k in range(30):
        seen, queue = set(), []
        for s, i, h in sheets:
            if s == f"s{k}" and h not in seen:
                seen.add(h)
                for f in fields:
                    score = sum(2 if h == w else 1 if w in h else 0 for w in f.keywords)
                    if score:
                        queue.append((-score, f.priority, f.field_id, i, h))
        taken, used = {}, set()
        for _, _, f, _, h in sorted(queue):
            if f not in taken and h not in used:
                taken[f] = h
                used.add(h)
        want.update({(f"s{k}", f.field_id): taken.get(f.field_id) for f in fields})
    got = {(r.sheet_id, r.field_id): r.header for r in mp.map_fields(headers, table).collect()}
    assert got == want


def test_mapping_gaps(spark):
    classified = hd.classify_columns(heads(spark, "Cliente", "Fecha"))
    typed = mp.field_types(mp.map_fields(heads(spark, "Cliente", "Fecha"), mp.field_table(spark)), classified)
    gap = mp.mapping_gaps(typed, mp.field_table(spark)).first()
    assert (gap.missing_required, gap.untyped_required, gap.ok) == (["direccion"], [], False)
    assert rows(typed.filter("header is not null").select("field_id", "type"), "field_id") == [("cliente", "select"), ("fecha_visita", "date")]
    assert typed.select(F.count("type")).first()[0] == 2
