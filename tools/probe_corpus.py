"""Check the derived corpus label counts against SURVEY 7.1 (sf0.01)."""
import sys

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from tagloom.session import get_session  # noqa: E402
from tagloom.sources import driver  # noqa: E402
from tagloom.functions import bio  # noqa: E402

spark = get_session("local[8]", shuffle_partitions=8)
r = driver.reviews(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
r.select(F.explode(bio.bio_split("BIO_anno")).alias("l")).groupBy("l").count().orderBy("l").show()
r.groupBy("class").count().orderBy("class").show()
print(r.filter(F.size(bio.bio_split("BIO_anno")) != F.length("text")).count(), "length mismatches")
