"""Language filters by held-out accuracy and definition, secrets by brute force and examples."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geodemand.llm.common import pick, utf8
from geodemand.llm.langid import LanguageFilter, grams, held_out, identify, keep_identified, learn_languages, training_rows
from geodemand.llm.secrets import base_spans, find_secrets, find_spans, lexed, redact_secrets, redacted, secrets_digest
from tests.llm.tables import documents, empty_documents


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÉñ Z.1\n", max_size=30), min_size=1, max_size=5))
def test_grams_do_not_depend_on_the_batch(texts):
    gram, first = grams(*utf8(pa.array(texts)), 4)
    for i, t in enumerate(texts):
        alone, _ = grams(*utf8(pa.array([t])), 4)
        assert sorted(alone.tolist()) == sorted(gram[first[i]:first[i + 1]].tolist())
        assert (len(alone) > 0) == any(c.isalpha() for c in t)


def test_filters_hold_their_grams_and_correct_false_positives():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 62, 3000, dtype=np.uint64) for _ in range(70)]  # more languages than bits in a word
    model = LanguageFilter([f"l{i:02}" for i in range(70)], members, 4, 3, 12)
    for k in (0, 63, 64, 69):
        mask = None
        for at in model.places(members[k]):
            mask = model.rows[k // 64][at] if mask is None else mask & model.rows[k // 64][at]
        assert ((mask >> np.uint64(k % 64)) & np.uint64(1)).all()
    strangers = rng.integers(0, 1 << 62, 200_000, dtype=np.uint64)
    hit = np.ones(len(strangers), dtype=bool)
    for at in model.places(strangers):
        hit &= (model.rows[0][at] & np.uint64(1)).astype(bool)
    assert abs(hit.mean() - model.false_rate[0]) < 0.003


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn_languages(training_rows(docs))
    got = identify(docs, model).where(held_out(F.col("doc_id")))
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    # the prediction depends on the text alone
    blind = identify(docs.select("text", F.lit("zz").alias("lang")), model).select("text", "lang_pred")
    assert blind.exceptAll(identify(docs, model).select("text", "lang_pred")).isEmpty()


def test_language_edge_cases(spark):
    docs, rows = documents(spark)
    model = learn_languages(training_rows(docs))
    assert set(model.languages) <= {"aa", "bb"}
    got = identify(docs, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"Text", "shard", "lang_pred"}
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.lang_score <= 1
    assert identify(docs.limit(0), model).count() == 0
    untaught = learn_languages(training_rows(empty_documents(spark)))
    assert {r.lang_pred for r in identify(docs, untaught).collect()} == {"und"}
    assert keep_identified(docs, untaught).count() == len(rows)
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(len(r.t) for r in pick(kept, t="text").collect()) == sorted(
        len(r["text"]) for r in got if r.lang_pred != "und" and r.lang_score >= 0.2)


_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                     r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base_by_hand(text):
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


_BITS = st.sampled_from(["password", "passwd", "SeCrEt", "token", "api_key", "ApiKey", "paßword", "ſecret", "toKen", "=", ":", " ", '"', "'",
                         "AKIA", "AKIAABCDEFGHIJ12", "0123456789abcdef", "deadbeef", "x" * 11, "Y0/+_.-=", "é", "\n", "a=b"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_BITS, max_size=25))
def test_base_spans_by_definition(bits):
    text = "".join(bits)
    spans = sorted(base_spans(text), key=lambda s: (s.start, ("assign", "access", "hex").index(s.kind)))
    assert [f"{s.kind}:{s.start}:{s.end}" for s in spans] == _base_by_hand(text)
    everything = find_spans(text, 0.45)
    assert [s for s in everything if s.kind != "lexed"] == spans
    assert redacted(text, [], "#") == text


def test_lexer_follows_names():
    def hidden(text):
        return sorted(text[s.start:s.end] for s in lexed(text, 0.45))

    assert hidden('db_password = "hT9$kL2!vQ8z"') == ["hT9$kL2!vQ8z"]
    assert hidden('k = "Zx81-qPw7-Lm22"\nclient_secret = k') == ["Zx81-qPw7-Lm22"]
    assert hidden('a = "Zx81-qPw7-Lm22"\nb = a\nclient_secret = cfg.b') == ["Zx81-qPw7-Lm22"]
    assert hidden('p1 = "aB3dE"; p2 = "fG6hI9jK"\nsigning_key = p1 + p2') == ["aB3dE", "fG6hI9jK"]
    assert hidden('PW=pl9XXaa71bb\nDB_PASSWORD="${PW}"') == ["pl9XXaa71bb"]
    assert hidden('"privateKey": "Qm9vR2FsYXh5MTI",') == ["Qm9vR2FsYXh5MTI"]
    assert hidden("<password>pl9-XX-aa71</password>") == ["pl9-XX-aa71"]
    assert hidden("tool --auth-token zzAA11bb22cc") == ["zzAA11bb22cc"]
    assert hidden("postgres://joe:S3cr3tPw9x@host/db") == ["S3cr3tPw9x"]
    for clean in ('name = "hT9$kL2!vQ8z"', 'k = "Zx81-qPw7-Lm22"', "Password: incorrect", "api_key = YOUR_KEY_HERE", "token_count = 123456",
                  "The secret of good prose: write and rewrite.", 'password = ""', 'if password == "x": pass', "secret: ${UNSET}"):
        assert hidden(clean) == [], clean
    assert redacted("a password=abcdefghijkl, b", find_spans("a password=abcdefghijkl, b", 0.45), "#") == "a password=#, b"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "k", "=", "+", '"', "'", "\\", "Zx81qPw7Lm22", "${k}", "k", ":", ",", "<k>", "</k>", "--k", " ", "\n"]), max_size=40))
def test_lexer_takes_anything(bits):
    text = "".join(bits)
    for s in find_spans(text, 0.45):
        assert 0 <= s.start <= s.value_start < s.end <= len(text)


def test_secrets_query_and_redaction(spark):
    docs, rows = documents(spark)
    extra = spark.createDataFrame([(900, 'x token: "abcdEFGH1234" é AKIA0123456789ABCD'), (901, None)], "doc_id long, text string")
    table = pick(docs, doc_id="doc_id", text="text").unionByName(extra)
    got = {r.doc_id: r for r in secrets_digest(find_secrets(table)).collect()}
    base = _base_by_hand('x token: "abcdEFGH1234" é AKIA0123456789ABCD')
    assert got[900].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and got[900].spans == ",".join(base)
    assert (got[900].n_assign, got[900].n_access, got[900].n_hex) == (1, 1, 0) and got[901].spans == ""
    masked = redact_secrets(docs)
    assert masked.columns == docs.columns and masked.exceptAll(docs).isEmpty()
    assert redact_secrets(table).where("doc_id = 900").first().text == 'x token: "<secret>" é <secret>'
    assert find_secrets(empty_documents(spark)).count() == 0
