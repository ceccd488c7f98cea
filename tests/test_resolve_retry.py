"""Batched lookups with retries (F6-F8): policy, batching, failed batches become misses."""

import math

import pytest

from tessera.operators.resolve import RetryPolicy, TransientError, chunked, remote_lookup


class Flaky:
    def __init__(self, failures, status=429, retry_after=None):
        self.failures, self.status, self.retry_after, self.calls = failures, status, retry_after, 0

    def __call__(self):
        self.calls += 1
        if self.calls <= self.failures:
            raise TransientError("boom", status=self.status, retry_after=self.retry_after)
        return "ok"


def test_retries_then_succeeds_with_backoff():
    slept = []
    fn = Flaky(2)
    assert RetryPolicy().call(fn, sleep=slept.append) == "ok"
    assert fn.calls == 3 and slept == [0.5, 1.0]


def test_exhaustion_is_initial_plus_retries():
    fn = Flaky(10, status=503)
    with pytest.raises(TransientError):
        RetryPolicy(max_retries=3).call(fn, sleep=lambda s: None)
    assert fn.calls == 4


def test_non_retryable_status_fails_at_once():
    fn = Flaky(1, status=404)
    with pytest.raises(TransientError):
        RetryPolicy().call(fn, sleep=lambda s: None)
    assert fn.calls == 1


def test_retry_after_wins_and_is_not_capped():
    p = RetryPolicy()
    assert p.delay(0, retry_after=2) == 2.0
    assert p.delay(0, retry_after=10_000) == 10_000.0
    assert p.delay(0, retry_after="120") == 120.0
    assert p.delay(0, retry_after=-3) == 0.0
    assert p.delay(0, retry_after="Wed, 21 Oct 2015 07:28:00 GMT") == p.delay(0)
    assert p.delay(10) == p.cap


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 85])
def test_chunked_batch_count(n):
    batches = list(chunked(list(range(n)), 40))
    assert len(batches) == math.ceil(n / 40)
    assert [x for b in batches for x in b] == list(range(n))


def test_remote_lookup_failed_batch_becomes_misses(spark):
    ids = spark.createDataFrame([(f"id{i}",) for i in range(10)], "id string").coalesce(1)

    def fetch(batch):
        if "id4" in batch:  # the whole batch holding id4 keeps failing
            raise TransientError("down", status=503)
        return [{"id": i, "v": float(i[2:])} for i in batch]

    out = remote_lookup(ids, fetch, "id string, v double", batch_size=3, sleep=lambda s: None)
    got = sorted(r["id"] for r in out.collect())
    # batches: [0,1,2] [3,4,5] [6,7,8] [9] -> the second one is lost
    assert got == ["id0", "id1", "id2", "id6", "id7", "id8", "id9"]


@pytest.mark.parametrize("status", [500, 501, 507, 599])
def test_every_server_error_is_retried(status):
    fn = Flaky(1, status=status)
    assert RetryPolicy().call(fn, sleep=lambda s: None) == "ok"


def test_faults_of_the_caller_go_up(spark):
    def fetch(batch):
        raise KeyError("a bug")

    with pytest.raises(Exception, match="a bug"):
        remote_lookup(spark.createDataFrame([("x",)], "id string"), fetch, "id string", sleep=lambda s: None).collect()
