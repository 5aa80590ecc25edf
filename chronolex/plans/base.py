"""Registration of queries, and the tables they share, in Spark and in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.operators import evidence, store, syndication
from chronolex.plans.instants import INSTANTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    """The corpus at a folder: tables as they are, and the views of them that queries share."""

    def __init__(self, spark: SparkSession, sf: str):
        self._spark, self._sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._sf}/{name}.parquet")

    @property
    def dated(self) -> DataFrame:
        return store.dated(self.documents, self.sources)

    @property
    def times(self) -> DataFrame:
        """(doc_id, source_id, ts, told) of all documents, read from published_at once per session."""
        return scratch.once(self._spark, ("times", self._sf), lambda: self.dated.select("doc_id", "source_id", "ts", "told"))

    @property
    def claim_rows(self) -> DataFrame:
        """Claims, each id once."""
        return self.claims.dropDuplicates(["id"])

    @property
    def anchored(self) -> DataFrame:
        """Claims with the time and source of their document: (claim_id, own_doc, kind, salience, anchor_ts, own_source)."""
        c = self.claim_rows.select(F.col("id").alias("claim_id"), F.col("doc_id").alias("own_doc"), "kind", "salience")
        return c.join(self.times.select(F.col("doc_id").alias("own_doc"), F.col("ts").alias("anchor_ts"), F.col("source_id").alias("own_source")), "own_doc")

    @property
    def verdicts(self) -> DataFrame:
        """The first verdict of each claim, document and direction, with its weight and clipped confidence."""
        return store.first_verdicts(self.judgements)

    @property
    def evidence(self) -> DataFrame:
        """Verdicts after the check of their quotes, made once per session."""
        return scratch.once(self._spark, ("evidence", self._sf), lambda: evidence.downgraded(evidence.checked(self.verdicts, self.documents)).drop("ok"))

    @property
    def canonical(self) -> DataFrame:
        """(doc_id, canonical) of documents that share a story with others, made once per session."""
        return scratch.once(self._spark, ("canonical", self._sf), lambda: syndication.canonicals(self.times, syndication.classes(self.documents)))


DATED = f"""{INSTANTS}, d AS (SELECT x.doc_id, x.id, x.source_id, x.source, x.url, x.title, x.text, x.lang, x.n_chars, coalesce(pub.utc, CAST(floor(epoch(x.retrieved_at)) AS BIGINT)) AS ts, pub.utc IS NOT NULL AS told FROM documents x LEFT JOIN pub USING (doc_id))"""
CLAIMS = "c AS (SELECT id AS claim_id, any_value(doc_id) AS doc_id, any_value(kind) AS kind, any_value(salience) AS salience, any_value(fingerprints) AS fingerprints FROM claims GROUP BY id)"
ANCHORED = f"{DATED}, {CLAIMS}, a AS (SELECT claim_id, c.doc_id AS own_doc, kind, salience, d.ts AS anchor_ts, d.source_id AS own_source FROM c JOIN d USING (doc_id))"
WEIGHTS = """w(direction, relation, weight) AS (VALUES ('prior','identical',1.0::DOUBLE),('prior','paraphrase',0.95),('prior','subsumes',0.85),('prior','partial',0.45),('prior','topical',0.05),('prior','unrelated',0.0),
  ('later','states',1.0),('later','entails',0.9),('later','anticipates_directionally',0.5),('later','partially_anticipates',0.3),('later','orthogonal',0.0),('later','contradicts',-1.0))"""
VERDICTS = f"""{WEIGHTS}, vr AS (SELECT claim_id, doc_id, direction, CASE WHEN (direction, relation) IN (SELECT (direction, relation) FROM w) THEN relation WHEN direction = 'prior' THEN 'unrelated' ELSE 'orthogonal' END AS relation, least(greatest(coalesce(confidence, 0.5), 0), 1) AS conf, quote, attributes_source FROM
  (SELECT *, row_number() OVER (PARTITION BY claim_id, doc_id, direction ORDER BY judged_at, relation, coalesce(confidence, -1), coalesce(quote, '')) AS rn FROM judgements WHERE direction IN ('prior', 'later')) WHERE rn = 1),
v AS (SELECT vr.*, weight FROM vr JOIN w USING (direction, relation))"""
NORM = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[ \\t\\r\\n]+', ' ', 'g'))"
CHECKED = f"""t AS (SELECT doc_id, {NORM('text')} AS txt FROM documents), n AS (SELECT v.*, {NORM('quote')} AS qn, txt FROM v LEFT JOIN t USING (doc_id)), m AS (SELECT *, string_split(qn, ' ') AS w FROM n),
k AS (SELECT *, coalesce(length(qn) >= 12 AND (contains(txt, qn) OR (len(w) >= 4 AND len(list_filter(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')), lambda r: contains(txt, r))) >= greatest(1, (len(w) - 3) // 2))), false) AS ok FROM m),
kf AS (SELECT *, NOT ok AND (direction = 'prior' AND relation IN ('identical','paraphrase','subsumes','partial') OR direction = 'later' AND relation <> 'orthogonal') AS fall FROM k),
kd AS (SELECT claim_id, doc_id, direction, CASE WHEN fall AND direction = 'prior' THEN 'topical' WHEN fall THEN 'orthogonal' ELSE relation END AS relation, CASE WHEN fall THEN least(conf, 0.3) ELSE conf END AS conf, CASE WHEN fall THEN '' ELSE quote END AS quote, attributes_source FROM kf)"""
#: ends in ev: the verdicts after the check of their quotes
EVIDENCE = f"{VERDICTS}, {CHECKED}, ev AS (SELECT kd.*, w.weight FROM kd JOIN w USING (direction, relation))"
#: ends in canon(doc_id, canonical): copies by plain MinHash, banded, linked directly or through others, and their earliest document
CANON = r"""sw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]+') AS w FROM documents WHERE text IS NOT NULL), ss AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM sw)),
sb AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS base, count(*) OVER (PARTITION BY doc_id) AS n FROM ss), se AS (SELECT i, ('0x' || substr(sha256('seed' || i), 1, 8))::BIGINT AS seed FROM range(64) t(i)),
sg AS MATERIALIZED (SELECT doc_id, list(value ORDER BY i) AS sig FROM (SELECT doc_id, i, min(xor(base, seed)) AS value FROM sb, se WHERE n >= 20 GROUP BY doc_id, i) GROUP BY doc_id),
bd AS (SELECT doc_id, sig, b, sig[b * 4 + 1:b * 4 + 4] AS key FROM sg, range(16) r(b)),
sl AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bd x JOIN bd y USING (b, key) WHERE x.doc_id < y.doc_id AND len(list_filter(list_zip(x.sig, y.sig), lambda p: p[1] = p[2])) / 64.0 >= 0.55),
sn AS (SELECT a AS x, b AS y FROM sl UNION SELECT b, a FROM sl), reach AS (SELECT x AS node, x AS low FROM sn UNION SELECT sn.y, reach.low FROM reach JOIN sn ON sn.x = reach.node WHERE reach.low < sn.y),
cls AS (SELECT node AS doc_id, min(low) AS class_id FROM reach GROUP BY node)"""
CANONICAL = f"{CANON}, canon AS (SELECT cls.doc_id, first_value(cls.doc_id) OVER (PARTITION BY class_id ORDER BY d.ts, cls.doc_id) AS canonical FROM cls JOIN d USING (doc_id))"
