"""pagewise: reading-log analytics as Spark DataFrame jobs.

Three logical tables drive everything:

* ``reader`` (user_id, user_nm, user_email)
* ``shelf``  (one row per book on a reader's shelf, keyed by user_id, b_isbn)
* ``record`` (pages read per day: user_id, b_isbn, r_date, r_page)

Every operator works on all readers in one distributed pass; an optional
``user`` argument narrows it to one reader (the single-user view of the
original application).
"""

from pagewise.session import build_session, state_root

__all__ = ["build_session", "state_root"]
