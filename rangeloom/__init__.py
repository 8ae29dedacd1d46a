"""Analytics over ordered coordinate axes, declared with the Spark DataFrame API."""
