"""lodgecast: booking-cancellation analytics as PySpark DataFrame jobs."""
