from truegauge.functions.arrays import (dot, entropy, log_sum_exp, softmax)
from truegauge.functions.hashing import hash_bucket, hash_order
from truegauge.functions.stats import correlation, slope
from truegauge.functions.timing import bin_of, micros

__all__ = ["bin_of", "correlation", "dot", "entropy", "hash_bucket", "hash_order",
           "log_sum_exp", "micros", "slope", "softmax"]
