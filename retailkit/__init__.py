"""retailkit: multi-branch retail analytics as Spark DataFrame jobs.

Layout
------
sources/    typed scans of the supplied tables and the retail adapter
functions/  Column-returning helpers (scalar rules, scope predicates)
operators/  reusable relational building blocks (interval join, running
            sums, FEFO allocation, sequential acceptance, upsert, nesting)
plans/      the reports and change-application jobs built from the above
streaming/  Structured Streaming variants of the live reports
"""

__version__ = "0.1.0"
