import re

from millrace.sources import jobs


def records(spark):
    rows = [(i, f'{{"jobs":[{{"job_id":{i % 7},"job_state":"s{i}"}},{{"job_id":"x","job_state":"step"}}]}}') for i in range(60)]
    return jobs.accounting_entries(spark.createDataFrame(rows, "seq long, value string"), order_by="seq")


def test_no_sort_of_a_file_split_before_the_shuffle(spark):
    plan = jobs.accounting_jobs(records(spark), ("state",))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert not re.search(r"\bSort\b|Aggregate", below)
    assert plan.count("Exchange hashpartitioning") == 1


def test_last_record_of_an_id_wins(spark):
    got = {r.job_id: r.state for r in jobs.accounting_jobs(records(spark), ("state",)).collect()}
    assert got == {str(k): f"S{max(i for i in range(60) if i % 7 == k)}" for k in range(1, 7)}
