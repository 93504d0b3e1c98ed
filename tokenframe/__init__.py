"""tokenframe: byte-pair encoding and text preparation as Spark DataFrame operators."""
