"""looplake — feedback analytics and continuous-training data work on Spark.

Every public function takes DataFrames (plus a :class:`Config` and explicit
parameters such as ``as_of``) and returns a DataFrame; nothing is collected to
the driver unless the function is documented as returning a small scalar.
"""

from looplake.config import Config

__all__ = ["Config"]
__version__ = "0.1.0"
