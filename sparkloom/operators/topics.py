"""Topic models and label classifiers: Spark ML where it has them, hooks elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, HashingTF, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .. import schemas
from ..columns import fresh
from ..functions.text import clean_text
from . import mixtures

class Vocabulary(Estimator):
    """Fits Spark's ``CountVectorizerModel``: the commonest terms (ties: by term) that at least ``min_df`` rows have, and at
    most a share ``max_df`` of the rows.

    Counted as a grouping of the rows' terms, summed before they are sent and dealt over the
    session's shuffle partitions; ``CountVectorizer`` deals them over as many parts as the input has.
    """

    def __init__(self, terms: str, counts: str, size: int, min_df: float, max_df: float):
        super().__init__()
        self.terms, self.counts, self.most, self.min_df, self.max_df = terms, counts, size, min_df, max_df

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        n = dataset.count()
        share = lambda x: x if x >= 1 else x * n
        # Each term of a row adds to its count, each distinct one to its number of rows.
        every = F.transform(self.terms, lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("df")))
        once = F.transform(F.array_distinct(self.terms), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("df")))
        counted = dataset.select(F.inline(F.concat(every, once))).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        kept = counted.where((F.col("df") >= share(self.min_df)) & (F.col("df") <= share(self.max_df)))
        words = [r["term"] for r in kept.orderBy(F.desc("n"), "term").limit(self.most).collect()]  # the vocabulary
        return CountVectorizerModel.from_vocabulary(words, inputCol=self.terms, outputCol=self.counts)


def topic_pipeline(topics: int = 8, max_iter: int = 20, vocabulary: int = 3000, min_df: float = 5.0, seed: int = 42) -> Pipeline:
    """Tokens of two letters or more without stop words, with their pairs, to counts to topics.

    The settings of ``fit_topics``, which carries these stages out in fewer steps (``mixtures``): every
    iteration sees every row once.
    """
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="clean", outputCol="tokens", pattern=r"\s+", minTokenLength=2),
            StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=_stop_words()),
            NGram(n=2, inputCol="kept", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
            Vocabulary("terms", "features", vocabulary, min_df, 0.9),
            LDA(k=topics, optimizer="online", maxIter=max_iter, subsamplingRate=1.0, seed=seed),
        ]
    )


def _stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english") + schemas.TOPIC_STOPWORDS


def fit_topics(rows: DataFrame, text: str, **settings) -> mixtures.TopicModel:
    """The topics of all rows' texts under the settings of ``topic_pipeline``."""
    _, _, _, _, terms, lda = topic_pipeline(**settings).getStages()
    texts, stop = rows.select(F.col(text).alias("text")), _stop_words()
    words = mixtures.vocabulary(texts, stop, terms.most, terms.min_df, terms.max_df)
    return mixtures.fit(texts, words, stop, lda.getK(), lda.getMaxIter(), lda.getSeed(), lda.getLearningOffset(), lda.getLearningDecay())


def keywords(model: mixtures.TopicModel, n: int = 10) -> DataFrame:
    """(topic_id, keywords): the model's own words, as many topics as it has."""
    told = [(i, ", ".join(words)) for i, words in enumerate(model.top_terms(n))]
    return SparkSession.active().createDataFrame(told, "topic_id int, topic_keywords string")


def assign(model: mixtures.TopicModel, rows: DataFrame, text: str) -> DataFrame:
    """Each row's most likely topic (ties: the first) and how likely it is.

    A text without any word of the vocabulary is equally likely to be of every topic.
    """
    stop, place = _stop_words(), rows.columns.index(text)

    def run(batches):  # type: ignore[no-untyped-def]
        import pyarrow as pa

        told = mixtures.shares(model, stop)
        for batch in batches:
            for part in mixtures._small(batch):
                found = told(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.argmax(1).astype("int32")), pa.array(found.max(1))], [*part.schema.names, "topic_id", "topic_confidence"])

    schema = StructType([*rows.schema.fields, StructField("topic_id", IntegerType()), StructField("topic_confidence", DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("topic_confidence", F.round("topic_confidence", 4))


def labelled(assigned: DataFrame, model: mixtures.TopicModel, n: int = 10) -> DataFrame:
    """Rows with the keywords of their topic; a topic is one row of a table as long as the model has topics."""
    return assigned.join(F.broadcast(keywords(model, n)), "topic_id", "left").select(*assigned.columns, "topic_keywords")


def topic_pivot(assigned: DataFrame, by: str, topics: int = 8) -> DataFrame:
    return assigned.groupBy(by).pivot("topic_id", list(range(topics))).agg(F.count(F.lit(1))).na.fill(0)


def fit_labels(rows: DataFrame, text: str, label: str, features: int = 1 << 16, smoothing: float = 1.0) -> PipelineModel:
    """A complement naive Bayes model of hashed words and pairs, fitted by Spark on all labelled rows, in one pass.

    Rows without a label don't count; a null text has no words. There must be a labelled row.
    """
    known = rows.where(F.col(label).isNotNull()).select(_cleaned(text).alias("clean"), F.col(label).alias("label_text"))
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label_text", outputCol="label_number", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol="clean", outputCol="own_words", pattern=r"\s+"),
            NGram(n=2, inputCol="own_words", outputCol="own_pairs"),
            SQLTransformer(statement="SELECT *, concat(own_words, own_pairs) AS own_terms FROM __THIS__"),
            HashingTF(inputCol="own_terms", outputCol="own_features", numFeatures=features, binary=True),
            NaiveBayes(featuresCol="own_features", labelCol="label_number", smoothing=smoothing, modelType="complement", probabilityCol="own_shares", predictionCol="own_guess", rawPredictionCol="own_raw"),
        ]
    ).fit(known)


def _cleaned(text: str) -> Column:
    return clean_text(F.coalesce(F.col(text), F.lit("")))


def labelled_by(fitted: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``sentiment`` struct(label, score): the likeliest label (ties: the first) and how likely it is.

    The columns of ``rows`` come back unchanged, whatever their names.
    """
    labels = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
    kept = fresh("kept", rows)
    # The model sees the clean text only, so that no column clashes with its own.
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(kept), _cleaned(text).alias("clean"))
    shares = vector_to_array("own_shares")
    best = F.array_position(shares, F.array_max(shares)).cast("int")
    done = PipelineModel(fitted.stages[1:]).transform(own)
    return done.select(f"{kept}.*", F.struct(F.element_at(labels, best).alias("label"), F.round(F.array_max(shares), 4).alias("score")).alias("sentiment"))


def classify(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[tuple[str, float]]]] | PipelineModel) -> DataFrame:
    """``sentiment`` struct(label, score): by a model hook, loaded once per task, or a model of ``fit_labels``."""
    if isinstance(model, PipelineModel):
        return labelled_by(model, rows, text)
    import pandas as pd

    def run(frames):  # type: ignore[no-untyped-def]
        predict = model()
        for frame in frames:
            found = predict(frame[text].tolist())
            yield frame.assign(sentiment=[{"label": a, "score": round(b, 4)} for a, b in found]) if len(frame) else frame.assign(sentiment=pd.Series([], dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, sentiment struct<label:string,score:double>")
