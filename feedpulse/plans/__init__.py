"""feedpulse.plans"""
