"""The registered topic model sees all texts."""

from sparkloom.operators import topics
from sparkloom.plans import queries


def test_topics_come_from_all_texts(spark, sf, monkeypatch):
    made, real = [], topics.topic_pipeline
    monkeypatch.setattr(topics, "topic_pipeline", lambda **settings: made.append(real(**settings)) or made[-1])
    assert queries.lda_topics(spark, sf).count() > 0
    lda = made[0].getStages()[-1]
    assert lda.getMaxIter() == 20 and lda.getSubsamplingRate() == 1.0
