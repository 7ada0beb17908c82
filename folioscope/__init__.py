"""Document-pair quality analytics on Spark: operators over pages, blocks, lines, logs and queues."""
