"""tidewire: message-pipeline analytics as Spark DataFrame jobs.

Event logs, resource samples, scenario grids and message payloads of many
runs are analysed in one job: the run keys travel in the data, so no query
loops over runs on the driver.
"""
