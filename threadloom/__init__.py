"""threadloom: conversation-evidence analytics and training-data preparation on Spark."""
