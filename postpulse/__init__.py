"""postpulse: forum-post popularity analytics as Spark DataFrame jobs.

Layout
------
sources/    table loading, CSV/TSV/text readers and writers, derived fixtures
functions/  Column-level building blocks (cleaning, time parts, sentiment, hashing)
operators/  DataFrame -> DataFrame operators (engagement, slices, sampling, features)
plans/      multi-stage jobs (Spark ML models, bagged multiway regression trees)
streaming/  Structured Streaming versions of the line-at-a-time feature jobs
"""

from postpulse.session import build_session, shared_dir, scratch_path

__all__ = ["build_session", "shared_dir", "scratch_path"]
