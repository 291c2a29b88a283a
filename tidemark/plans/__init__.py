"""The bronze, silver and gold layers, and the batch jobs that write them."""
