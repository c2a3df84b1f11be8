import random

import pytest

from quern.llm.pairs import DEFECTS, broken_pairs, features, fit_on, read_answer, train_model

EN = ["The host sent {} packets to the proxy before noon.", "Analysts at {} tied the burst to a known loader.", "Check whether port {} is still open on the server.", "No payload was kept, so the link to case {} stays weak."]
DE = ["Der Rechner hat {} Pakete an den Server gesendet.", "Bitte prüfen Sie, ob der Port {} noch offen ist.", "Die Daten von {} sind nicht vollständig und werden noch geprüft."]
ASK = "Explain what happened to host {} and which checks are needed for the shift."


def table(n=400, seed=1):
    rng = random.Random(seed)
    fill = lambda bank: " ".join(rng.choice(bank).format(rng.randrange(100, 9999)) for _ in range(rng.randint(2, 5)))
    rows, want = [], {}
    for i in range(n):
        german = rng.random() < 0.15
        ask = f"Erklären Sie, was mit dem Rechner {i} geschehen ist und welche Daten fehlen." if german else ASK.format(i)
        ans = fill(DE if german else EN)
        kind = rng.choice(["ok"] * 12 + ["empty", "truncated", "refusal", "copied", "language"])
        if kind == "empty":
            ans = rng.choice([None, "", "{}", "n/a", '{"summary": ""}', "```json\n```"])
        elif kind == "truncated":
            ans = ans[: ans.rindex(" ")].rstrip(".") + " bec"
        elif kind == "refusal":
            ans = rng.choice(["I am sorry, but I cannot help with this request.", "Unfortunately, I must decline to answer.", "I'm not able to assist with that."])
        elif kind == "copied":
            ans = rng.choice(["{}", "You asked: {}", '"{}"']).format(ask)
        elif kind == "language":
            ans = fill(EN if german else DE)
        if kind != "ok":
            want[i] = kind
        rows.append((i, ask, ans, ans, 60, 256))
    return rows, want


SCHEMA = "generation_id long, instruction string, output string, raw_output string, generated_tokens int, max_new_tokens int"


def test_held_out_accuracy(spark):
    fitting, _ = table(600, 1)
    model = train_model(spark.createDataFrame(fitting, SCHEMA), "instruction", ["output"], "generation_id", "generated_tokens", "max_new_tokens")
    rows, want = table(500, 2)
    got = {r.generation_id: r.defect for r in broken_pairs(spark.createDataFrame(rows + rows[:9], SCHEMA), model=model).where("field = 'output'").collect()}
    right = sum(want.get(k) == v for k, v in got.items())
    assert right / len(got) > 0.9 and right / len(want) > 0.9


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "Explain the alert on host 7 and say what is needed.", None, "", None, None), (2, None, "The host sent the packets before noon. The proxy closed the session.", "null", 5, 9)], SCHEMA)
    got = {(r.generation_id, r.field): r.defect for r in broken_pairs(df).collect()}
    assert got.get((1, "output")) == "empty" and got.get((1, "raw_output")) == "empty" and got.get((2, "raw_output")) == "empty"
    assert broken_pairs(df.limit(0)).count() == 0


def test_layouts():
    assert read_answer('```json\n{"a": "x", "b": ["y", null]}\n```').said == "x\ny"
    assert read_answer('{"a": "x').broken and read_answer("```json\n{").open_fence
    assert read_answer(None).said == "" and read_answer('{"a": {}}').said == ""


@pytest.fixture(scope="module")
def model():
    rows, _ = table(600, 4)
    return fit_on([(r[1], r[2], r[4], r[5]) for r in rows])


def defects(model, texts, asked=ASK.format(7)):
    n = len(texts)
    s = model.scores(*features([asked] * n, texts, [60] * n, [256] * n, model.reader))
    return [DEFECTS[int(row.argmax())] if (row >= model.threshold).any() else None for row in (s * (s >= model.threshold))]


REST = "Writing such a text might help someone who means harm, and that is a risk nobody should take. Our terms say that requests of this sort are to be turned down in every case. A trained person near you can look into the details and tell you what is safe. You could also read the advice of your national agency, which explains the first steps in plain words."
FIRST = "Questions about attacks come up often, and many of them are asked in good faith by people who defend their own systems. The subject is wide, and opinions about what should be public differ a good deal among those who work in the field."


def test_long_refusals_are_seen(model):
    import json

    cores = ["I am sorry, but I cannot help with this request.", "Unfortunately, I must decline to answer.", "I am not able to assist with that.", "As an AI, I can't provide this.", "I won't be able to answer this.", "I'd rather not write about this topic.", "It would not be appropriate for me to reply.", "My guidelines do not allow me to discuss it.", "I have to refuse this task.", "This is not something I can talk about."]
    said = [f"{c} {REST}" for c in cores] + [f"{FIRST} {c} {REST}" for c in cores] + [json.dumps({"summary": f"{c} {REST}"}) for c in cores]
    assert all(len(t.split()) >= 60 for t in said)
    assert sum(d == "refusal" for d in defects(model, said)) >= 0.95 * len(said)


def test_statements_about_refusing_are_answers(model):
    said = ["The proxy refused the connection, and the host was unable to reach the server.", "The gateway declined our request twice because the policy was out of date.", "The vendor cannot help with old versions, so the server stays unpatched.", "An apology was sent to users whose logins were rejected.", "The resolver refused 42 queries from the guest network.", "The client could not answer the challenge and was not permitted to log in.", "Access to the share was denied after the third attempt.", "The agency declined to comment on the outage.", "The switch will not accept the new rule until noon.", "The mail server rejected 17 messages and sent no answer."]
    said += [f"{a} {b}" for a, b in zip(said, said[1:] + said[:1])]
    assert sum(d is not None for d in defects(model, said)) <= 0.05 * len(said)


def test_languages_never_seen_in_the_table(model):
    said = {
        "pl": ["Serwer odrzucił połączenie, a host nie mógł się z nim skontaktować.", "Analitycy powiązali ten ruch ze znanym programem i sprawdzają dzienniki.", "Nie zachowano żadnych danych, więc związek ze sprawą pozostaje słaby.", "Nocą ktoś kilka razy próbował zalogować się na stare konto."],
        "sv": ["Servern nekade anslutningen och värden kunde inte nå den.", "Analytikerna knöt trafiken till ett känt program och granskar loggarna.", "Inga data sparades, så kopplingen till fallet är fortfarande svag.", "Någon försökte flera gånger logga in på det gamla kontot."],
        "tr": ["Sunucu bağlantıyı reddetti ve makine ona ulaşamadı.", "Analistler trafiği bilinen bir programa bağladı ve kayıtları inceliyor.", "Hiçbir veri saklanmadı, bu yüzden olayla bağlantı zayıf kalıyor.", "Gece birisi eski hesaba birkaç kez girmeye çalıştı."],
        "de": ["Der Server lehnte die Verbindung ab, und der Rechner konnte ihn nicht erreichen.", "Die Fachleute haben den Verkehr einem bekannten Programm zugeordnet.", "In der Nacht hat jemand mehrmals versucht, sich am alten Konto anzumelden.", "Es wurden keine Daten gespeichert, daher bleibt der Zusammenhang schwach."],
    }
    for texts in said.values():
        assert sum(d == "language" for d in defects(model, texts)) >= 0.9 * len(texts)
