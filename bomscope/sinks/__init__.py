"""Files for people and other systems. Bulk output is Spark's own writers; exact single files are written by the driver."""
