"""traitlens: wide-trait tables, class cohorts, boosted trees and attributions on PySpark."""

from traitlens.session import local_session

__all__ = ["local_session"]
