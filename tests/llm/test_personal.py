from lorekeep.llm import personal as P
from lorekeep.llm import texts

NAMES = [("Elke", "given", "latin"), (" maeve ", "given", "latin"), ("Will", "given", "latin"), ("Torvick", "family", "latin"), ("HALACRE", "family", "latin"), ("Brenquist", "family", "latin"), ("澜", "given", "han"), ("舟", "given", "han"), ("欧阳", "family", "han"), ("路", "family", "han"), (None, "given", "han"), ("", "family", "han")]
UNIT = "src string, record_id string, msg_pos int, text string"


def found(spark, data, names=NAMES):
    df = spark.createDataFrame([("memory", str(i), 0, t) for i, t in enumerate(data)], UNIT)
    listed = spark.createDataFrame(names, "name string, part string, script string")
    out = {}
    for r in P.items(df, listed).orderBy("record_id", "start").collect():
        out.setdefault(int(r["record_id"]), []).append((r["pii_type"], r["nth"], data[int(r["record_id"])][r["start"] : r["end"]]))
    return out


SEEDS = {
    "email": ["elke.t+x@mail.example", "d@y.test"],
    "phone": ["+86 135-0000-6745", "+49 30 23125 210"],
    "id_number": ["110199197904145021", "11019919630827990X"],
    "address": ["946 Millrace Avenue, Apt 5B, Greyhaven, NM 33205", "云岭省松川市临湖区银杏大道248号B座12层"],
}
OTHERS = {
    "email": ["b_1 [at] corp [dot] example", "C@X.EXAMPLE", "d＠y.test"],
    "phone": ["(320) 555-0117", "07700 900518", "01 99 00 93 97", "021-55501356", "１５６０００００５２１", "13600000473"],
    "id_number": ["739-74-5356", "QQ 97 51 61 A", "E58697335", "98643271C"],
    "address": ["1405 Osierbed Road\nAltbrook\nWO19 7NA", "Weihergasse 32b, 44786 Altbrück", "5 bis rue des Tisserands, 81328 Villebrune", "Calle del Molino 5, 5º B, 24481 Valdeluna"],
}


def test_items_of_every_kind_are_reached(spark):
    said = [(kind, f"all about the {kind.replace('_', ' ')}: {v} ; so much") for part in (SEEDS, OTHERS) for kind, values in part.items() for v in values]
    for values, place in ((["110199197904145022"], "id_number"),):  # a wrong check digit is no seed, but of a known form
        said += [(place, f"all about the {place.replace('_', ' ')}: {v} ; so much") for v in values]
    got = found(spark, [t for _, t in said])
    for i, (kind, text) in enumerate(said):
        assert got[i] == [(kind, 1, text[text.index(": ") + 2 : -len(" ; so much")])], text


def test_without_rounds_only_seeds(spark):
    said = [(part is SEEDS, f"all about the {kind}: {v} ; so much") for part in (SEEDS, OTHERS) for kind, values in part.items() for v in values]
    df = spark.createDataFrame([("memory", str(i), 0, t) for i, (_, t) in enumerate(said)], UNIT)
    listed = spark.createDataFrame(NAMES, "name string, part string, script string")
    assert {int(r["record_id"]) for r in P.items(df, listed, 0).collect()} == {i for i, (seed, _) in enumerate(said) if seed}


def test_shapes_carry_over_to_other_contexts(spark):
    known = [f"call me on: {v} ; thanks" for v in ("+86 135-0000-6745", "+49 30 23125 210", "(320) 555-0117", "(320) 555-0118", "07700 900518")]
    got = found(spark, [*known, "elsewhere (612) 555-0190 stands", "nothing 01 99 00 93 97 known", "call me on: 9565490231157731 ; thanks"])
    assert got[5] == [("phone", 1, "(612) 555-0190")] and 6 not in got and 7 not in got


def test_several_items_of_a_text(spark):
    data = [
        "Call +86 135-0000-6745, +49 30 23125 210 or +1 415.555.0192; ids 110199197904145021, 11019919630827990X",
        "Elke Torvick, Halacre, Maeve; ELKE O'TORVICK met Maeve R. van der Halacre and Elke Maeve Torvick-Halacre. 和欧阳舟、路澜舟说",
    ]
    got = found(spark, data)
    assert [x[:2] for x in got[0]] == [("phone", 1), ("phone", 2), ("phone", 3), ("id_number", 1), ("id_number", 2)]
    assert [x[2] for x in got[1]] == ["Elke Torvick", "Halacre, Maeve", "ELKE O'TORVICK", "Maeve R. van der Halacre", "Elke Maeve Torvick-Halacre", "欧阳舟", "路澜舟"]


RESEMBLING = [
        "git clone git@git.host.example:core/x.git", "postgres://svc:pw@db-1.example:5432/app", "ssh deploy@glyph-writer-89.example", "icon@2x.png", "`@types/node@5.2.4`", "root@build-71625:/srv# ls",
        "Order no. 2026-77569-10282 and build 10.24473.3.87523", "Trace 9565490231157731 took 23 ms", "Listen on 10.37.0.12:8443, fallback 192.0.2.41", "uuid 5f0e89410-9c1b-4a7e-a14827-001143877", "status codes 200 404 502 503",
        "The Will Return flag and the Grace Period timer", "Spring Boot, Apache Kafka and Visual Studio", "Route 53 answers", "梧桐路 607", ""
]


def test_what_only_resembles(spark):
    assert found(spark, RESEMBLING) == {}


def test_unseen_parts_are_learnt_from_patterns(spark):
    known = [f"My name is {g} {f} and I own it" for g in ("Elke", "Maeve", "Will") for f in ("Torvick", "Halacre", "Brenquist")]
    data = [*known, "My name is Xenia Torvick and I own it", "My name is Elke Sorhurst and I own it", "ask Xenia Sorhurst", "The Open Window closed", "我是欧阳澜，这", "我是路舟，这", "我是路澜，这", "我是童舟，这", "问童澜舟"]
    got = found(spark, data)
    assert got[11] == [("name", 1, "Xenia Sorhurst")] and 12 not in got
    assert got[17] == [("name", 1, "童澜舟")]


def test_no_names_no_texts(spark):
    assert found(spark, ["Elke Torvick a@b.example"], [(None, None, None)]) == {0: [("email", 1, "a@b.example")]}
    empty = spark.createDataFrame([], UNIT)
    assert P.items(empty, spark.createDataFrame(NAMES, "name string, part string, script string")).count() == 0


def test_redacted_text_stays_readable(spark):
    df = spark.createDataFrame([("memory", "a", 0, "Hi Elke Torvick <e@x.example>,\ncall +61 491 570 324!"), ("memory", "b", 0, "nothing " * 50_000)], UNIT)
    got = {r["record_id"]: r for r in P.redact(df, spark.createDataFrame(NAMES, "name string, part string, script string")).collect()}
    assert got["a"]["text"] == "Hi <NAME> <<EMAIL>>,\ncall <PHONE>!" and got["a"]["items"] == 3
    assert got["b"]["text"] == "nothing " * 50_000 and got["b"]["items"] == 0


def test_units_once(spark):
    s = spark.createDataFrame([(" A\n", [("user", "x"), ("user", None), (None, "")]), ("a", [("user", "x")]), (None, [("user", "y")]), (" ", None)], "sessionId string, conversation array<struct<role:string,content:string>>")
    m = spark.createDataFrame([("m", "b"), ("m", "b"), (None, "c"), ("n", None)], "id string, body string")
    t = spark.createDataFrame([("t", "p")], "task_id string, prompt string")
    assert sorted(tuple(r) for r in texts.units(s, m, t).collect()) == [("memory", "m", 0, "b"), ("session", "a", 0, "x"), ("task", "t", 0, "p")]
