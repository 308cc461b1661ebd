"""docquarry: document retrieval, answer checking and corpus preparation on Spark."""
