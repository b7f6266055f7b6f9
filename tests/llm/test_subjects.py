import re

import pytest

from strataloom.llm import subjects as S

CURATED = S.Lexicon(S.curated())


def brute_hits(sentence, lexicon):
    """Every term of the lexicon as whole words, longest only within its subject, by regular expressions."""
    padded = f" {sentence} "
    found = [(m.start(), m.start() + 1 + len(t), i) for i, (t, _, _) in enumerate(lexicon.rows) for m in re.finditer(rf"(?=( {re.escape(t)})(s|es|n|en)? )", padded)]
    rows = lexicon.rows
    return sorted(i for a, b, i in found if not any(x <= a and b <= y and y - x > b - a and rows[j][1] == rows[i][1] for x, y, j in found))


@pytest.mark.parametrize(
    "sentence",
    ["The query planner and the foreign keys", "VaccinationList needs a prescription", "`card_charge` was declined", "l'accès: jeton d’accès", "", "Datenbanken und Abfrageplan", "read replicas lag; the replica", "Prüfungsversuch, Schlüsselwechsel", "the table", "data processing agreement, processing agreement"],
)
def test_automaton_equals_regular_expressions(sentence):
    assert sorted(CURATED.sentence_hits(S.plain(sentence))) == brute_hits(S.plain(sentence), CURATED)


def test_sentences_lengths_and_mojibake():
    assert S.sentences_of("One thing. Another!\nA third <p>and a 4th</p>") == ["one thing", "another", "a third", "and a 4th"]
    assert CURATED.document_hits("Ohne SchlÃ¼sselwechsel geht es nicht. Ja.") == CURATED.document_hits("Ohne Schlüsselwechsel geht es nicht. Ja.") != (2, [])
    assert CURATED.document_hits(None) == CURATED.document_hits("") == CURATED.document_hits(" \n ") == (0, [])


def test_marks_silence_a_sentence():
    marked = S.Lexicon([*S.curated(), ("apropos", "", 0.0)])
    assert marked.document_hits("Apropos, the foreign key broke. The foreign key broke.")[1] == CURATED.document_hits("The foreign key broke.")[1]


def test_assign_two_subjects_and_none(spark):
    law = "Our lawyers want a privacy notice. The court order names a licence clause. "
    sport = "The coach wants a training session. Runners are timed at the marathon. "
    rows = [(1, law * 2), (2, law + sport), (3, law * 8 + "The coach agrees."), (4, "Thanks, looks good to me."), (5, None), (6, ""), (7, (law * 40_000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, body string, subject string")
    got = {(r.id, r.subject) for r in S.assign(df, "id", "body").collect()}
    assert got == {(1, "law"), (2, "law"), (2, "sport"), (3, "law"), (7, "law")}
    assert S.assign(df.limit(0), "id", "body").collect() == []
    assert S.assign(df.limit(0), "id", "body", df.limit(0).select("id", "subject")).collect() == []


def test_terms_and_marks_are_learned_from_labels(spark):
    """Words that no list holds, and a phrase that stands where a subject is only touched."""
    rows, labels = [], []
    for i in range(240):
        subject = ("law", "sport", "health")[i % 3]
        word = {"law": "zorvex pact", "sport": "quibber field", "health": "nolum cure"}[subject]
        other = {"law": "stadium", "sport": "hospital", "health": "lawyer"}[subject]
        rows.append((i, f"We looked at the {word} today. It went on for {i} days. But let us set aside the {other}."))
        labels.append((i, subject))
    df, known = spark.createDataFrame(rows, "id long, body string"), spark.createDataFrame(labels, "id long, subject string")
    lexicon = S.learn(df, "id", "body", S.labelled_sample(known, "id"))
    learned = {(t, s) for t, s, _ in lexicon.rows}
    assert {("zorvex", "law"), ("quibber", "sport"), ("nolum", "health")} <= learned and ("zorvex pact", "law") not in learned
    assert ("set aside", "") in learned and ("looked at", "") not in learned
    got = {(r.id, r.subject) for r in S.assign(df, "id", "body", known).collect()}
    assert got == set(labels)


def test_calibration_uses_labels(spark):
    scored = spark.createDataFrame([(i, "law", 0.1 * i, 1.0) for i in range(60)], "id long, subject string, evidence double, density double")
    sample = S.labelled_sample(spark.createDataFrame([(i, "law" if i >= 9 else "none") for i in range(60)] * 2 + [(None, "law"), (3, None)], "id long, subject string"), "id")
    least = S.calibrate(scored, sample, "id")
    assert 0.8 < least["law"][0] <= 0.91
    assert least["sport"] == least["law"]
    assert S.calibrate(scored, sample.limit(0), "id")["law"] == S.DEFAULT_THRESHOLDS


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/subject_labels.parquet")
    fit = labels.filter("doc_id % 2 = 0")
    held = {(r.doc_id, r.subject) for r in labels.filter("doc_id % 2 = 1 AND subject <> 'none'").collect()}
    ids = {r.doc_id for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {(r.doc_id, r.subject) for r in S.assign(documents, "doc_id", "text", fit).collect() if r.doc_id in ids}
    assert 2 * len(got & held) / (len(got) + len(held)) > 0.8


#: Texts written by hand for this test, apart from the tables: what the curated terms alone make of other prose.
WRITTEN = [
    ("databases", "Our reporting job timed out again. The optimizer chose a sequential scan over the big orders relation, and the foreign key had no index behind it."),
    ("databases", "After the failover the replica was eleven minutes behind, so people read stale rows from PostgreSQL."),
    ("databases", "Die Abfrage läuft zwar, aber ohne Fremdschlüssel liefert die Datenbank doppelte Zeilen."),
    ("education", "The university moved every seminar online. Students hand their homework to a tutor, and lecturers mark it within a week."),
    ("education", "Le lycée a publié l'emploi du temps. Chaque élève reçoit ses devoirs le lundi."),
    ("education", "Parents met the teacher to talk about the curriculum for next school year."),
    ("finance", "The accountant found that the invoice was paid twice and asked the bank for a refund of 300 euros."),
    ("finance", "Quarterly profit rose although cash flow was weak; shareholders still expect a dividend."),
    ("finance", "La factura incluye el IVA y la forma de pago cambió este mes."),
    ("frontend", "On hover the tooltip covers the button. I changed the stylesheet so that the sidebar keeps its width in the browser."),
    ("frontend", "Switching to dark mode breaks the font size of the navbar until React renders again."),
    ("health", "The nurse measured the patient's blood pressure before surgery and noted an allergy to penicillin."),
    ("health", "A new vaccine lowers the risk of infection; the hospital offers it to all doctors."),
    ("health", "Der Arzt änderte die Dosierung, weil der Blutdruck im Krankenhaus stieg."),
    ("law", "The judge dismissed the lawsuit because the licence had expired and no liability was shown."),
    ("law", "Under the GDPR a person may withdraw consent at any time; our lawyer rewrote the privacy policy."),
    ("machine_learning", "We trained a neural network on more training data, lowered the learning rate, and it still overfits."),
    ("machine_learning", "The language model hallucinated a citation. A second classifier now filters such answers before inference ends."),
    ("mobile", "Since the last release the Android build drains the battery, and iPhone users miss every push notification."),
    ("mobile", "Swipe gestures stopped working on tablets with a cracked touchscreen."),
    ("operations", "The rollout was paused when Kubernetes killed three pods. On call engineers blamed a memory limit."),
    ("operations", "Last night's backup failed and monitoring stayed silent during the outage."),
    ("security", "Attackers guessed a weak password by brute force; we now demand two factor authentication."),
    ("security", "The penetration test uncovered cross site scripting, so the vulnerability got a CVE."),
    ("sport", "The striker scored twice before halftime, yet the referee gave a penalty and the league leaders won."),
    ("sport", "Elle a gagné le championnat après les tirs au but ; l'entraîneuse pleurait."),
    ("sport", "She won Olympic gold in the marathon, her third medal as an athlete."),
    ("statistics", "With a sample size of forty the confidence interval is wide, and the p value says little."),
    ("statistics", "Remove the outlier and the correlation vanishes; the median hardly moves."),
    ("none", "Thanks for the quick reply. I will have a look tomorrow morning and write again."),
    ("none", "The garden needs rain. We walked along the river until the sun went down over the hills."),
    ("none", "Bitte den Termin verschieben, ich bin bis Freitag unterwegs."),
    ("none", "Grandmother's soup is best with leeks, two carrots and a pinch of nutmeg."),
]


def test_texts_written_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(WRITTEN)], "id long, body string")
    got = {(r.id, r.subject) for r in S.assign(df, "id", "body").collect()}
    want = {(i, s) for i, (s, _) in enumerate(WRITTEN) if s != "none"}
    assert len(got & want) / len(want) >= 0.9, want - got
    assert len(got & want) / len(got) >= 0.9, got - want
