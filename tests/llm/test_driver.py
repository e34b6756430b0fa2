"""What the driver keeps: it has one process for all stages, so what one of them leaves counts in the next."""

from oxbow.llm import language, ngrams, quality
from oxbow.session import table

DATA = "/root/testdata/sf0.001"


def test_training_hands_memory_back(spark, monkeypatch):
    called = []
    for module in (quality, language):
        monkeypatch.setattr(module, "give_back", lambda name=module.__name__: called.append(name), raising=False)
    docs = table(spark, DATA, "documents")
    quality.train_on(docs, table(spark, DATA, "labels"), per_label=20)
    language.train_on(docs, per_label=5)
    assert called == [quality.__name__, language.__name__]


def test_near_documents_collect_garbage_as_they_go(spark):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))

    before = collections()
    assert ngrams.near_documents(table(spark, DATA, "documents")).count() == table(spark, DATA, "documents").count()
    # four in near_documents itself at least, and one for each round of the components
    assert collections() - before >= 6
