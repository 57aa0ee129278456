"""Connected components of a link table, without gathering links in one place.

Defined cases: links without an a or a b count for nothing; a link of an id to itself makes it a class of its own; repeated links change nothing; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.shared import cut, tasks_for


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Gives id and class, the smallest id that is reachable, for every id in links.

    Each round sends every id the smallest class among its neighbours and itself, and then the class of that class; the
    number of rounds grows with the logarithm of a class's diameter. Ends when no class changes. Empty links give no row.
    """
    links = links.select("a", "b").dropna()
    n = 2 * links.count()
    links = links.coalesce(tasks_for(n))
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n)
    now = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), n)
    while True:
        near = both.join(now, both.b == now.id).coalesce(tasks_for(n)).groupBy("a").agg(F.min("class").alias("m"))
        step = now.join(near, now.id == near.a, "left").select("id", F.least("class", F.coalesce("m", "class")).alias("c"), F.col("class").alias("was"))
        step = cut(step, n)
        up = step.select(F.col("id").alias("c"), F.col("c").alias("further"))
        new = cut(step.join(up, "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("class"), "was"), n)
        now = new.select("id", "class")
        if new.where("class <> was").isEmpty():
            return now
